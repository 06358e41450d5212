"""Mixing sources to target weights, in DataFrame operations only.

The size of a document is its number of words (runs of anything but ASCII white space). The
sources, ordered by code point with null last, weigh 5, 2, 1, 5, 2, 1, ... They share
``share`` times the words of all documents by weight, but no source takes more than ``most``
times its own size; what it cannot take goes to the others by weight until no source is above.

That end state has one level L with target = least(most * size, weight * L): sources are full
in the order of most * size / weight, so one running sum over the sources finds L.

A source's repetition rate is its target by its size. Each of its documents is emitted
floor(rate) times, and once more if a hash of the doc_id, as a number in [0, 1), is below the
fraction of the rate. The draw depends on the doc_id and the seed alone: reruns agree, and
rows that repeat a doc_id are drawn alike. A source without words has the target 0; an empty table
gives no rows. Equal ratios of sources fill up in the order of their names. The words that a source takes differ from its target by the
spread of the draws: with the fraction f of the rate, a variance of f (1 - f) times the sum of the squared sizes of
its documents. Other columns, whatever their names, pass through ``mixed`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.components import fresh_names, saved

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from 32 bits of the md5 of the id and the seed; null for a null id counts as text ''."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":" + seed)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(2.0 ** 32)


def targets(sizes: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from rows of ``source, size``: one row per source, pre-aggregated before its shuffle."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("long")
    sources = sources.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    full_first = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = full_first.rowsBetween(Window.unboundedPreceding, -1)
    rest = full_first.rowsBetween(0, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest)
    leveled = sources.withColumn("level", level)
    # The sources below are full, so the first source that is not full has the common level.
    common = F.min(F.when(F.col("cap") >= F.col("weight") * F.col("level"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(Window.partitionBy())
    leveled = leveled.withColumn("common", common["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * F.col("common"), F.col("cap").cast("double")))
    return leveled.select("source", "source_size", target.alias("target"))


def _rated(sized: DataFrame) -> DataFrame:
    """``sized`` (doc_id, source, size, …) with the source's size and target, and the copies taken."""
    wanted = targets(sized).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    joined = sized.alias("d").join(wanted.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).drop(F.col("t.source"))
    whole = F.floor("rate")
    extra = (draw(F.col("doc_id")) < F.col("rate") - whole).cast("long")
    return joined.withColumn("copies", whole + extra)


def mixture(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row; texts are read once and never shuffled."""
    sized = saved(docs.select("doc_id", F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size")), "sizes")
    return _rated(sized).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix: every row as often as it is taken, its columns as they were."""
    names = docs.columns
    source, rate, copy = fresh_names(docs, "source_of_rate", "rate", "copy")
    rates = targets(docs.select(F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size")))
    rates = rates.select(F.col("source").alias(source), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(
        F.lit(0.0)).alias(rate))
    joined = docs.join(rates, docs["source"].eqNullSafe(F.col(source)))
    copies = F.floor(rate) + (draw(docs["doc_id"]) < F.col(rate) - F.floor(rate)).cast("long")
    taken = joined.where(copies > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    return taken.select(*[f"`{c}`" for c in names])


#: The same by DuckDB, with the level searched over all sources instead of a running sum.
MIXTURE_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         list_extract([5, 2, 1], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT) AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT (1.5 * (SELECT sum(source_size) FROM sources) - coalesce(sum(CASE WHEN 2.0 * b.source_size / b.weight < 2.0 * a.source_size / a.weight
            THEN 2 * b.source_size END), 0)::DOUBLE)
         / sum(CASE WHEN 2.0 * b.source_size / b.weight >= 2.0 * a.source_size / a.weight THEN b.weight END) AS level,
         2.0 * any_value(a.source_size) / any_value(a.weight) AS ratio
  FROM sources a CROSS JOIN sources b GROUP BY a.source),
chosen AS (SELECT arg_min(level, ratio) FILTER (WHERE ratio >= level) AS level FROM levels),
rates AS (
  SELECT source, source_size, least(2.0 * source_size, coalesce(weight * level, 2.0 * source_size))::DOUBLE AS target FROM sources, chosen)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{SEED}'), 1, 8))::BIGINT / 4294967296.0 < rate - floor(rate))::INT))::BIGINT AS taken
FROM (SELECT s.*, r.source_size, r.target, CASE WHEN r.source_size > 0 THEN r.target / r.source_size ELSE 0 END AS rate
      FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source)
"""
