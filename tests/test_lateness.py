"""Arrivals judged per symbol over several batches, restarts and timers."""

import datetime as dt
import time

import pytest

from barloom.streaming import lateness
from barloom.streaming.jobs import bar_stream

SCHEMA = "symbol string, date date, close double"


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def deliver(spark, folder, rows):
    spark.createDataFrame([(s, day(n), c) for s, n, c in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in"))


def run(spark, folder, **options):
    stream = bar_stream(spark, str(folder / "in"), SCHEMA, maxFilesPerTrigger=1)
    query = lateness.stream_judged(stream, str(folder / "taken"), str(folder / "rejected"), str(folder / "progress"), **options)
    query.awaitTermination()
    return query


def read(spark, path, *columns):
    return sorted((r["symbol"], (r["date"] - day(0)).days, *[r[c] for c in columns]) for r in spark.read.parquet(str(path)).collect())


def test_three_batches_are_judged_per_symbol(spark, tmp_path):
    # B is far ahead of A: a global watermark would have lost A's bars.
    deliver(spark, tmp_path, [("A", 1, 1.0), ("A", 5, 2.0), ("B", 200, 1.0)])
    query = run(spark, tmp_path, lateness_days=3)
    deliver(spark, tmp_path, [("A", 4, 1.0), ("A", 5, 9.0), ("A", 8, 1.0), ("B", 201, 1.0)])
    deliver(spark, tmp_path, [("A", 3, 1.0), ("A", 4, 7.0), ("A", 6, 1.0), ("A", 6, 2.0), ("A", 9, 1.0), ("B", 2, 1.0), ("C", 1, 2.0)])
    query = run(spark, tmp_path, lateness_days=3)
    assert read(spark, tmp_path / "taken", "close") == [
        ("A", 1, 1.0), ("A", 4, 1.0), ("A", 5, 2.0), ("A", 6, 1.0), ("A", 8, 1.0), ("A", 9, 1.0), ("B", 200, 1.0), ("B", 201, 1.0), ("C", 1, 2.0)]
    assert read(spark, tmp_path / "rejected", "status", "close") == [
        ("A", 3, "late", 1.0), ("A", 4, "late", 7.0), ("A", 5, "repeat", 9.0), ("A", 6, "repeat", 2.0), ("B", 2, "late", 1.0)]
    # Three newest dates and at most lateness + 1 = 4 seen dates a symbol.
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 3 + 3 * 4


def test_state_stays_bounded_however_long_the_series(spark, tmp_path):
    for part in range(3):
        deliver(spark, tmp_path, [("A", part * 100 + i, 1.0) for i in range(100)])
    query = run(spark, tmp_path, lateness_days=2)
    assert len(read(spark, tmp_path / "taken")) == 300
    assert [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress][-1] == 1 + 3


def test_the_session_keeps_its_state_store(spark):
    before = spark.conf.get(lateness.PROVIDER, None)
    with lateness.rocksdb_state(spark):
        assert spark.conf.get(lateness.PROVIDER) == lateness.ROCKSDB
    assert spark.conf.get(lateness.PROVIDER, None) == before


def test_timers_give_back_the_dates_of_silent_symbols(spark, tmp_path):
    deliver(spark, tmp_path, [("A", n, 1.0) for n in range(5)])
    stream = bar_stream(spark, str(tmp_path / "in"), SCHEMA)
    folders = [str(tmp_path / n) for n in ("taken", "rejected", "progress")]
    with pytest.raises(ValueError):
        lateness.stream_judged(stream, *folders, idle_ms=1)
    query = lateness.stream_judged(stream, *folders, lateness_days=9, idle_ms=1000, available_now=False)
    try:
        sizes, end = [], time.time() + 90
        while time.time() < end and not (sizes and max(sizes) >= 6 and sizes[-1] <= 2):
            time.sleep(0.5)
            sizes += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress[-1:] if p["stateOperators"]]
        assert max(sizes) >= 6 and sizes[-1] <= 2, sizes
    finally:
        query.stop()
    assert len(read(spark, tmp_path / "taken")) == 5
