"""Lateness judged per symbol: arrivals are taken, reported late, or reported as repeats.

A global watermark follows the fastest symbol and either loses the bars of a slower one or has to be
so wide that it bounds nothing. Here every symbol has its own newest date. A bar is taken if it is at
most ``lateness_days`` older than that and its date has not been seen; the state of a symbol is its
newest date and the dates seen within the lateness, so it is bounded by ``lateness_days`` + 1 entries.
A symbol that stays silent for ``idle_ms`` gives its dates back through a timer and keeps its newest
date alone; from then on only later bars are taken. Timers run with the wall clock, so a query that has
them never runs out of batches: they are for continuous triggers, not for ``available_now``.

The state lives in RocksDB, which spills to disk and is uploaded with the checkpoint, so a lost executor's
state is restored from there and a replayed batch gives the same rows.
"""

from __future__ import annotations

import datetime as dt
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATUS = "status"
TAKEN, LATE, REPEAT = "taken", "late", "repeat"


def _processor(lateness_days: int, idle_ms: int | None) -> StatefulProcessor:
    """The processor; its class is local, so that it travels to the workers by value."""

    class PerSymbolLateness(StatefulProcessor):
        """Adds ``status`` to every arriving row; the rows of a batch are judged in order of date, copies in order of arrival."""

        def init(self, handle) -> None:
            self.handle = handle
            self.newest = handle.getValueState("newest", "day date")
            self.seen = handle.getMapState("seen", "day date", "one boolean")

        def handleInputRows(self, key, rows, timerValues):
            batch = pd.concat(list(rows), ignore_index=True).sort_values("date", kind="stable", ignore_index=True)
            newest = self.newest.get()[0] if self.newest.exists() else None
            seen = {k[0] for k in self.seen.keys()} if self.seen.exists() else set()
            known, status = set(seen), []
            first = newest
            for day in batch["date"]:
                if first is not None and day <= first - dt.timedelta(days=lateness_days + 1):
                    status.append(LATE)
                elif day in seen or first is not None and not known and day <= first:
                    # Without dates (after the timer) nothing up to the newest one can be told from a repeat.
                    status.append(REPEAT)
                else:
                    status.append(TAKEN)
                    seen.add(day)
                    newest = day if newest is None or day > newest else newest
            if newest is not None:
                self.newest.update((newest,))
                for day in seen:
                    recent = day > newest - dt.timedelta(days=lateness_days + 1)
                    if recent and day not in known:
                        self.seen.updateValue((day,), (True,))
                    elif not recent and day in known:
                        self.seen.removeKey((day,))
            if idle_ms is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + idle_ms)
            batch[STATUS] = status
            yield batch

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.seen.clear()
            return iter(())

        def close(self) -> None:
            pass

    return PerSymbolLateness()


@contextmanager
def rocksdb_state(spark: SparkSession):
    """The state store this processor needs, for queries started inside; the session's setting is put back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def judged_arrivals(stream: DataFrame, lateness_days: int = 0, idle_ms: int | None = None) -> DataFrame:
    """The stream's rows (non-null ``symbol`` and ``date``) with a ``status``: taken, late or repeat."""
    schema = StructType([*stream.schema.fields, StructField(STATUS, StringType())])
    keyed = stream.where(F.col("symbol").isNotNull() & F.col("date").isNotNull())
    return keyed.groupBy("symbol").transformWithStateInPandas(
        _processor(lateness_days, idle_ms), schema, "append", "none" if idle_ms is None else "processingTime")


def stream_judged(stream: DataFrame, taken: str, rejected: str, checkpoint: str, lateness_days: int = 0, idle_ms: int | None = None,
                  available_now: bool = True) -> StreamingQuery:
    """Write taken rows and rejected rows (with their status) to two folders, each batch under its own ``batch`` value."""
    if available_now and idle_ms is not None:
        raise ValueError("timers need a continuous trigger: a query with timers always has another batch to run")

    def save(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("batch", F.lit(number)).persist()
        for path, rows in ((taken, batch.where(F.col(STATUS) == TAKEN).drop(STATUS)), (rejected, batch.where(F.col(STATUS) != TAKEN))):
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
        batch.unpersist()

    with rocksdb_state(stream.sparkSession):
        writer = judged_arrivals(stream, lateness_days, idle_ms).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
