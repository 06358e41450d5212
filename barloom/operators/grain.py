"""Bringing tables to the one-row-per-key grain.

Deduplication is an aggregation (``min_by``/``max_by`` on the ingest sequence),
not a ``row_number`` window: duplicates are combined before the shuffle, so one
key with very many copies never lands in a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedupe(df: DataFrame, keys=("symbol", "date"), seq="seq", keep="first") -> DataFrame:
    """One row per key: the first or the last in the ingest sequence ``seq``."""
    if keep not in ("first", "last"):
        raise ValueError("keep is 'first' or 'last'")
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys and c != seq]
    pick = F.min_by if keep == "first" else F.max_by
    picked = df.groupBy(*keys).agg(pick(F.struct(*rest), F.col(seq)).alias("__row"))
    return picked.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def latest_per_key(df: DataFrame, key="symbol", by="prediction_date") -> DataFrame:
    """The row with the greatest ``by`` of every key (``by`` unique within the key)."""
    return dedupe(df.withColumn("__seq", F.col(by)), keys=(key,), seq="__seq", keep="last").select(
        *df.columns
    )


def latest_date(df: DataFrame, column="date"):
    """Scalar subquery for the newest date of a table: the default for ``as_of``."""
    return df.agg(F.max(F.to_date(column))).scalar()
