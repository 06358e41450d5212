"""Connected components of links, by alternating star contraction on Spark tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.tokens import mix
from barloom.shared import fresh_path


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """The frame written to the shared folder and read back, so that its lineage ends there."""
    path = fresh_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


BITMAP_MOST = 1 << 26


def fresh_names(df: DataFrame, *wanted: str) -> list:
    """The wanted names, changed where the frame already has a column of that name in any case."""
    taken = {n.lower() for n in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def bitmap(keys: DataFrame, key: str) -> np.ndarray:
    """The bits, ``BITMAP_MOST`` at most, that the 64-bit numbers of a column set; tasks combine them before the driver does.

    The numbers are stored first: they often come from Python, and a task with two Python steps takes two workers, which stay.
    """
    keys = saved(keys.select(key), "bitmap-keys")
    bits = 1 << 16
    while bits < min(BITMAP_MOST, 16 * keys.count()):
        bits *= 2

    def run(batches):
        own = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            at = _bit_of(batch.column(0).to_numpy(), bits)
            np.bitwise_or.at(own, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        used = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(own[used].view(np.int64))], names=["word", "mask"])

    words = keys.mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64).view(np.uint64)
    return out


def _bit_of(values: np.ndarray, bits: int) -> np.ndarray:
    if values.dtype == np.int64:
        values = values.view(np.uint64)
    return mix(values.astype(np.uint64)) & np.uint64(bits - 1)


def in_bitmap(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the numbers may be in the bitmap: all that are, and a few more."""
    at = _bit_of(values, 64 * len(words))
    return (words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def maybe_in(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is in ``keys``, and a few more: a filter that runs before a shuffle.

    The keys set bits of a bitmap of at most 8 MB, which is all that is broadcast. The fuller
    it is the more other rows pass; the join that follows decides.
    """
    bits = 1 << 16
    while bits < min(BITMAP_MOST, 16 * keys.count()):
        bits *= 2
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    mask = F.expr(f"shiftleft(1L, cast(pmod(xxhash64({key}), {bits}) % 64 as int))")
    words = keys.select(F.floor(place / 64).alias("_word"), mask.alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_mask"))
    return df.withColumn("_word", F.floor(place / 64)).join(F.broadcast(words), "_word").where(
        F.col("_mask").bitwiseAND(mask) != 0).drop("_word", "_mask")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: neighbours above (large) or below (small) move to the least neighbour."""
    if large:
        edges = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
    joined = edges.join(least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v")))
    return moved.where("u != v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (its least node) for every node that has a link; nulls and self-links are ignored.

    Every round shuffles the links that are left; there are about as many rounds as the logarithm of the longest path.
    """
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = saved(edges, "links")
    state = None
    while True:
        edges = saved(_star(_star(edges, large=True), large=False), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 1_000_033)).first()
        if now == state:
            break
        state = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(nodes.select(F.col("component").alias("node"), "component").distinct())
