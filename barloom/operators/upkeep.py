"""Table upkeep as plain frame algebra: pending rows, upserts, retention, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from barloom.operators.grain import dedupe, latest_date


def pending_bars(incoming: DataFrame, stored: DataFrame, seq: str | None = None) -> DataFrame:
    """Incoming rows newer than the stored series of their symbol; all rows of new symbols.

    Of the copies of a key the last in ``seq`` counts, or the last in the order of the rows.
    """
    last = stored.groupBy("symbol").agg(F.max("date").alias("__last"))
    joined = incoming.join(last, "symbol", "left")
    fresh = joined.filter(F.col("__last").isNull() | (F.col("date") > F.col("__last"))).select(*incoming.columns)
    if seq is None:
        fresh, seq = fresh.withColumn("__seq", F.monotonically_increasing_id()), "__seq"
    return dedupe(fresh, seq=seq, keep="last").select(*[c for c in incoming.columns if c != seq])


def upsert(base: DataFrame, changes: DataFrame, keys, seq: str) -> DataFrame:
    """Union in which the row with the greatest ``seq`` of every key wins."""
    return dedupe(base.unionByName(changes), keys=tuple(keys), seq=seq, keep="last")


def refresh_symbols(stored: DataFrame, incoming: DataFrame, seq: str) -> DataFrame:
    """Replace every symbol present in ``incoming`` by its incoming rows (last copy wins)."""
    fresh = dedupe(incoming, seq=seq, keep="last")
    kept = stored.join(incoming.select("symbol").distinct(), "symbol", "left_anti")
    return kept.unionByName(fresh.select(*stored.columns))


def retain(df: DataFrame, days: int, as_of=None, date="date") -> DataFrame:
    anchor = latest_date(df, date) if as_of is None else as_of
    return df.filter(F.col(date) >= F.date_sub(anchor, days))


def expired_count(df: DataFrame, days: int, as_of=None, date="date") -> DataFrame:
    anchor = latest_date(df, date) if as_of is None else as_of
    old = F.col(date) < F.date_sub(anchor, days)
    return df.agg(F.count_if(old).alias("deleted"), F.count_if(~old).alias("kept"))


def symbol_codes(df: DataFrame) -> DataFrame:
    """Alphabetical index of every symbol, without collecting the symbols anywhere.

    The distinct symbols are range-sorted and numbered across partitions.
    """
    ordered = df.select("symbol").distinct().orderBy("symbol")
    schema = StructType([*ordered.schema.fields, StructField("symbol_code", LongType())])
    numbered = ordered.rdd.zipWithIndex().map(lambda pair: (pair[0][0], pair[1]))
    return df.sparkSession.createDataFrame(numbered, schema)
