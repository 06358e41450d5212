"""Approximate table statistics from sketches that are kept and merged.

A sketch row summarises one part of the table (a month, a bucket, a batch): exact counts, sums and
bounds, a HyperLogLog sketch of the symbols and a KLL sketch of the closes. Rows of different parts merge
without looking at the data again, so statistics of a growing table cost one pass over what is new,
and statistics of any selection of parts cost none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 12      # relative error of the symbol count about 1.04 / sqrt(2 ** 12) = 1.6 %
KLL_K = 200    # rank error of a quantile about 1.7 %
#: Bounds stated for users: three standard errors.
SYMBOL_BOUND, RANK_BOUND = 0.05, 0.05


def sketch(bars: DataFrame, part: Column) -> DataFrame:
    """One row per value of ``part``; tasks sketch their rows before the shuffle."""
    return bars.groupBy(part.alias("part")).agg(
        F.count(F.lit(1)).alias("records"), F.min("date").alias("min_date"), F.max("date").alias("max_date"),
        F.hll_sketch_agg(F.col("symbol").cast("string"), F.lit(LG_K)).alias("symbols"),
        F.kll_sketch_agg_double(F.col("close").cast("double"), F.lit(KLL_K)).alias("closes"))


def merged(*sketches: DataFrame) -> DataFrame:
    """Sketch rows of several tables by part; a part that occurs more than once is added up."""
    rows = sketches[0]
    for more in sketches[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("part").agg(*_sums())


def _sums():
    return [F.sum("records").alias("records"), F.min("min_date").alias("min_date"), F.max("max_date").alias("max_date"),
            F.hll_union_agg("symbols").alias("symbols"), F.kll_merge_agg_double("closes").alias("closes")]


def statistics(sketches: DataFrame, shares=(0.25, 0.5, 0.75)) -> DataFrame:
    """``total_records, min_date, max_date`` exactly, ``total_stocks`` and ``close_q25`` … approximately, over all parts."""
    whole = sketches.agg(*_sums())
    return whole.select(
        F.col("records").alias("total_records"), "min_date", "max_date", F.hll_sketch_estimate("symbols").alias("total_stocks"),
        *[F.kll_sketch_get_quantile_double("closes", F.lit(float(q))).alias(f"close_q{round(100 * q)}") for q in shares])
