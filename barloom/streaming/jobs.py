"""Incremental jobs: ingestion, running metadata, running averages, scoring of arrivals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.operators import validation as val
from barloom.operators.upkeep import pending_bars
from barloom.sources.store import BUCKETS, write_bars
from barloom.sources.versions import VersionedBars


def bar_stream(spark: SparkSession, path: str, schema, fmt="parquet", **options) -> DataFrame:
    return spark.readStream.schema(schema).options(**options).format(fmt).load(path)


def without_repeats(stream: DataFrame, lateness="30 days") -> DataFrame:
    """Drop repeated (symbol, date) rows that arrive within the allowed lateness."""
    timed = stream.withColumn("event_time", F.col("date").cast("timestamp"))
    timed = timed.withWatermark("event_time", lateness)
    return timed.dropDuplicatesWithinWatermark(["symbol", "date"]).drop("event_time")


def _start(writer, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_ingest(stream: DataFrame, table: str, checkpoint: str, buckets=BUCKETS, available_now=True):
    """Append arriving bars newer than the stored series of their own symbol.

    Lateness is judged per symbol against the store, which a global watermark cannot
    do; a replayed batch finds its rows stored already and appends nothing.
    """

    def absorb(batch: DataFrame, _: int) -> None:
        stored = batch.sparkSession.read.schema(batch.schema).parquet(table)
        write_bars(pending_bars(batch, stored), table, buckets, mode="append")

    return _start(stream.writeStream.foreachBatch(absorb), checkpoint, available_now)


def stream_into_versions(stream: DataFrame, path: str, checkpoint: str, available_now=True, **table):
    """Append arriving bars to a versioned table: a batch reads the table's metadata, never its bars.

    A replayed batch finds its rows in the metadata and commits nothing.
    """

    def absorb(batch: DataFrame, _: int) -> None:
        VersionedBars(batch.sparkSession, path, **table).append(batch)

    return _start(stream.writeStream.foreachBatch(absorb), checkpoint, available_now)


def running_metadata(stream: DataFrame) -> DataFrame:
    return stream.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("record_count"),
        F.max("date").alias("last_date"),
        F.max_by("close", "date").alias("last_close"),
    )


def stream_to_table(stream: DataFrame, table: str, checkpoint: str, mode="append", available_now=True):
    """Write every batch under its own ``batch`` value: replays overwrite, nothing doubles."""

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch").parquet(table)

    return _start(stream.writeStream.outputMode(mode).foreachBatch(save), checkpoint, available_now)


def newest_batch_per_symbol(spark: SparkSession, table: str) -> DataFrame:
    """Current value of an update-mode table: each symbol's row of its last batch."""
    rows = spark.read.parquet(table)
    rest = [c for c in rows.columns if c not in ("symbol", "batch")]
    newest = rows.groupBy("symbol").agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return newest.select("symbol", *[F.col(f"r.{c}").alias(c) for c in rest])


def stream_ema(stream: DataFrame, span: int, col="close") -> DataFrame:
    """Exponential average continued across batches; state per symbol: last value and date.

    Rows not newer than the last date of their symbol are left out, as in ingestion.
    """
    alpha = 2.0 / (span + 1)
    key_type = stream.schema["symbol"].dataType.simpleString()

    def advance(key, frames, state: GroupState):
        last, day = state.get if state.exists else (None, None)
        batch = pd.concat(list(frames), ignore_index=True).sort_values("date", kind="stable")
        if day is not None:
            batch = batch[batch["date"] > day]
        batch = batch.drop_duplicates("date", keep="last")
        if batch.empty:
            return
        values = batch[col].astype(float)
        seed = values if last is None else pd.concat([pd.Series([last]), values])
        smooth = seed.ewm(alpha=alpha, adjust=False).mean().to_numpy()[-len(batch):]
        state.update((float(smooth[-1]), batch["date"].iloc[-1]))
        yield pd.DataFrame({"symbol": key[0], "date": batch["date"].to_numpy(), "ema": smooth})

    return stream.select("symbol", "date", col).groupBy("symbol").applyInPandasWithState(
        advance, f"symbol {key_type}, date date, ema double", "ema double, last_date date",
        "append", GroupStateTimeout.NoTimeout,
    )


def score_arrivals(stream: DataFrame, predictions: DataFrame) -> DataFrame:
    """Forecasts scored as the bar of their date arrives: a stream-to-table equi-join."""
    return val.score(val.match_exact(predictions, stream))
