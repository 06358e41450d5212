"""The bar store and result sinks on Parquet.

Bars are partitioned by a hash bucket of the symbol, never by the symbol itself: the
number of directories stays fixed while symbols grow, a one-symbol read prunes to one
bucket, and an update rewrites only the buckets it touches.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.series import partitioned_by
from barloom.operators.grain import dedupe
from barloom.operators.upkeep import pending_bars, retain, upsert

BUCKETS = 256


def _bucket(buckets: int):
    return F.pmod(F.xxhash64(F.col("symbol").cast("string")), F.lit(buckets)).cast("int")


def _laid_out(df: DataFrame, buckets: int, order: str) -> DataFrame:
    """Rows clustered by bucket; the rebalance hint splits buckets too large for one task."""
    placed = df.withColumn("bucket", _bucket(buckets))
    return placed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "symbol", order)


def write_bars(df: DataFrame, path: str, buckets=BUCKETS, mode="overwrite", order="date") -> None:
    writer = _laid_out(df, buckets, order).write.mode(mode).partitionBy("bucket")
    writer.parquet(path)


def write_processed(bars: DataFrame, process, path: str, buckets=BUCKETS, mode="overwrite") -> None:
    """What ``process`` makes of the bars, series by series, stored without moving or sorting its wide rows.

    The bare bars go to their buckets, split into slices of symbols so that no task needs to hold a
    whole bucket, and every window of ``process`` keeps that distribution and order.
    """
    partitions = int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = -(-4 * partitions // buckets)
    piece = F.pmod(F.hash(F.col("symbol").cast("string")), F.lit(slices))
    placed = bars.withColumns({"bucket": _bucket(buckets), "__slice": piece}).repartition("bucket", "__slice")
    with partitioned_by("bucket", "__slice", "symbol"):
        wide = process(placed)
    wide.drop("__slice").write.mode(mode).option("compression", "zstd").partitionBy("bucket").parquet(path)


def read_bars(spark: SparkSession, path: str, symbol=None, buckets=BUCKETS) -> DataFrame:
    """Stored bars; one symbol reads one bucket and skips row groups by statistics."""
    df = spark.read.parquet(path)
    if symbol is not None:
        home = F.pmod(F.xxhash64(F.lit(str(symbol))), F.lit(buckets)).cast("int")
        df = df.filter((F.col("bucket") == home) & (F.col("symbol") == F.lit(symbol)))
    return df.drop("bucket")


def _replace_buckets(df: DataFrame, path: str, buckets: int, order: str) -> None:
    writer = _laid_out(df, buckets, order).write.mode("overwrite").partitionBy("bucket")
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def _stored_in_touched_buckets(spark, path, incoming, buckets) -> DataFrame:
    touched = incoming.select(_bucket(buckets).alias("bucket")).distinct()
    stored = spark.read.parquet(path)
    return stored.join(touched, "bucket", "left_semi").drop("bucket")


def refresh_stored_symbols(spark: SparkSession, path: str, incoming: DataFrame, seq: str, buckets=BUCKETS) -> None:
    """Replace the whole series of every incoming symbol; other buckets stay untouched."""
    fresh = dedupe(incoming, seq=seq, keep="last")
    stored = _stored_in_touched_buckets(spark, path, incoming, buckets)
    kept = stored.join(incoming.select("symbol").distinct(), "symbol", "left_anti")
    _replace_buckets(kept.unionByName(fresh.select(*kept.columns)), path, buckets, "date")


def append_pending(spark: SparkSession, path: str, incoming: DataFrame, buckets=BUCKETS, seq=None) -> None:
    """Append what is newer than the stored series, the last copy of a key; running it twice adds nothing."""
    write_bars(pending_bars(incoming, read_bars(spark, path), seq), path, buckets, mode="append")


def upsert_stored(spark, path: str, changes: DataFrame, keys, buckets=BUCKETS, order="prediction_date") -> None:
    """Last write per key wins (forecasts, validations); rewrites only touched buckets."""
    stored = _stored_in_touched_buckets(spark, path, changes, buckets).withColumn("__seq", F.lit(0))
    merged = upsert(stored, changes.withColumn("__seq", F.lit(1)), keys, "__seq")
    _replace_buckets(merged, path, buckets, order)


def write_retained(spark, path: str, out: str, days: int, as_of=None, buckets=BUCKETS, date="date") -> None:
    """A copy of the store without rows older than ``days``; switch readers to it afterwards."""
    df = read_bars(spark, path)
    write_bars(retain(df, days, as_of, date), out, buckets, order=date)


def export_csv(df: DataFrame, path: str, by: str | None = "symbol") -> None:
    """CSV with a header, in one folder per value of ``by``; ``read_bar_files`` reads it back.

    The rows of a symbol are brought together first, so that a task writes few folders.
    """
    if by is not None:
        df = df.repartition(by).sortWithinPartitions(by, *[c for c in ("date",) if c in df.columns])
    writer = df.write.mode("overwrite").option("header", True)
    (writer if by is None else writer.partitionBy(by)).csv(path)


def save_model(model: PipelineModel, path: str, metrics: DataFrame | None = None) -> None:
    model.write().overwrite().save(f"{path}/model")
    if metrics is not None:
        metrics.write.mode("overwrite").parquet(f"{path}/metrics")


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/model")
