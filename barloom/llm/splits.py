"""Label splits and bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GRAIN = 1_000_000


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id's text modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % modulus


def sampled(keys: DataFrame, bound: int, key: str = "doc_id") -> DataFrame:
    """About ``bound`` rows (never more than twice as many), chosen by a hash of ``key``: all rows of a smaller table."""
    count = keys.count()
    share = min(1.0, bound / count) if count else 1.0
    return keys.where(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(_GRAIN)) < int(share * _GRAIN) + 1).limit(2 * bound)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, bound: int) -> DataFrame:
    """``doc_id, text, label`` (0/1) of a bounded sample of the labelled rows outside the held-out split.

    Labels that are null or not 0/1 are left out; of several labels of one id the largest counts.
    The sample has at most ``2 * bound`` ids, so its broadcast is bounded and no text is shuffled.
    """
    usable = labels.where(F.col(label).isin(0, 1) & (remainder("doc_id", modulus) != held))
    chosen = sampled(usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")), bound)
    return docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").join(
        F.broadcast(chosen), "doc_id")


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))
