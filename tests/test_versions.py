"""The versioned bar table against a dictionary, its pruning, its commits and its metadata."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barloom.schema import BARS
from barloom.sources import versions
from barloom.sources.versions import VERSION, VersionedBars

DAY = dt.date(2020, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(s, DAY + dt.timedelta(days=d), c, c, c, c, 1) for s, d, c in rows], BARS)


def contents(df):
    got = [(r["symbol"], (r["date"] - DAY).days, r["close"]) for r in df.collect()]
    assert len({g[:2] for g in got}) == len(got)
    return {g[:2]: g[2] for g in got}


def state_of(model, synced):
    out = {}
    for s in {k[0] for k in model}:
        days = [k[1] for k in model if k[0] == s]
        out[s] = (len(days), max(days), model[s, max(days)], synced[s])
    return out


def check(table, model, synced):
    assert contents(table.read()) == model
    got = {r["symbol"]: (r["record_count"], (r["last_date"] - DAY).days, r["last_close"], str(r["last_sync"])[:10]) for r in table.state().collect()}
    assert got == state_of(model, synced)


def test_a_commit_of_many_rows_takes_larger_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "FILES", 4)
    table = VersionedBars(spark, str(tmp_path / "t"), rows_per_file=10)
    model = {(f"S{i:02d}", d): float(d) for i in range(10) for d in range(30)}
    table.create(frame(spark, [(s, d, c) for (s, d), c in model.items()]))
    assert table.files().where("kind = 'base'").count() <= 4
    table.merge(frame(spark, [(s, d, -1.0) for s, d in model if d < 20]))
    table.compact()
    assert contents(table.read()) == model | {k: -1.0 for k in model if k[1] < 20}
    assert table.files().where("kind = 'base'").count() <= 4
    monkeypatch.setattr(versions, "ROWS_PER_FILE", 40)
    other = VersionedBars(spark, str(tmp_path / "u"), rows_per_file=10)
    other.create(frame(spark, [(s, d, c) for (s, d), c in model.items()]))
    assert 4 < other.files().where("kind = 'base'").count() <= 8


def test_random_changes_equal_a_dictionary(spark, tmp_path):
    rng = random.Random(6)
    symbols = [f"S{i:02d}" for i in range(12)]
    model, synced = {}, {}
    table = VersionedBars(spark, str(tmp_path / "t"), rows_per_file=20)
    first = [(s, d, float(d)) for s in symbols[:8] for d in range(10)]
    table.create(frame(spark, first), synced_at="2024-01-01")
    model.update({(s, d): c for s, d, c in first})
    synced.update({s: "2024-01-01" for s in symbols[:8]})
    check(table, model, synced)
    for step in range(6):
        at = f"2024-02-{step + 1:02d}"
        kind = ["append", "merge", "replace", "append", "compact", "merge"][step]
        some = rng.sample(symbols, 4)
        rows = [(s, rng.randrange(25), float(rng.randrange(1000))) for s in some for _ in range(6)]
        rows = list({r[:2]: r for r in rows}.values())
        if kind == "append":
            last = {s: max((k[1] for k in model if k[0] == s), default=-1) for s in some}
            new = {(s, d): c for s, d, c in rows if d > last[s]}
            assert table.append(frame(spark, rows), synced_at=at) == len(new)
            assert table.append(frame(spark, rows), synced_at="2025-01-01") == 0
            model.update(new)
            synced.update({s: at for s, _ in new})
        elif kind == "merge":
            table.merge(frame(spark, rows), synced_at=at)
            model.update({(s, d): c for s, d, c in rows})
            synced.update({s: at for s in some})
        elif kind == "replace":
            table.replace(frame(spark, rows), synced_at=at)
            model = {k: v for k, v in model.items() if k[0] not in some} | {(s, d): c for s, d, c in rows}
            synced.update({s: at for s in some})
        else:
            table.compact()
            kinds = {r["kind"] for r in table.files().collect()}
            assert kinds == {"base", "meta"}
        check(table, model, synced)
    table.retain(5)
    newest = max(k[1] for k in model)
    assert contents(table.read()) == {k: v for k, v in model.items() if k[1] >= newest - 5}


def test_last_copy_of_a_batch_counts(spark, tmp_path):
    table = VersionedBars(spark, str(tmp_path / "t"))
    table.create(frame(spark, [("A", 0, 1.0)]))
    batch = frame(spark, [("A", 1, 5.0), ("A", 1, 7.0), ("B", 0, 2.0)]).coalesce(1)
    assert table.append(batch) == 2
    assert contents(table.read()) == {("A", 0): 1.0, ("A", 1): 7.0, ("B", 0): 2.0}
    table.merge(frame(spark, [("A", 1, 8.0), ("A", 1, 9.0)]).withColumn("seq", -F.col("close")), "seq")
    assert contents(table.read())[("A", 1)] == 8.0


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    table = VersionedBars(spark, str(tmp_path_factory.mktemp("large") / "t"), rows_per_file=1000)
    rows = spark.range(400 * 500).select(
        F.format_string("S%04d", F.floor(F.col("id") / 500)).alias("symbol"), F.date_add(F.lit(DAY), (F.col("id") % 500).cast("int")).alias("date"),
        *[F.rand(1).alias(c) for c in ("open", "high", "low", "close")], F.lit(1).cast("long").alias("volume"))
    table.create(rows)
    return table


def _scanned(df):
    return {f for f in df.inputFiles()}


def test_a_read_opens_only_the_files_that_can_hold_it(large):
    total = large.files().where("kind = 'base'").count()
    assert total >= 150
    one = large.read(["S0123"])
    assert len(_scanned(one)) <= 3 and one.count() == 500
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()


def test_a_corrected_symbol_rewrites_less_than_a_hundredth(large):
    size = large.files().where("kind = 'base'").agg(F.sum("bytes")).first()[0]
    before = {r["file"] for r in large.files().collect()}
    large.merge(large.read(["S0123"]).limit(20).withColumn("close", F.lit(-1.0)))
    new = [r for r in large.files().collect() if r["file"] not in before]
    assert sum(r["bytes"] for r in new if r["kind"] != "meta") < size / 100
    plan = large.read()._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan
    assert large.compact() <= 3
    after = [r for r in large.files().where("kind = 'base'").collect()]
    assert sum(r["bytes"] for r in after if r["file"] not in before) < size / 50
    assert large.read(["S0123"]).where("close = -1").count() == 20 and large.read().count() == 400 * 500


def test_an_append_reads_metadata_and_not_the_bars(large, monkeypatch):
    opened = []
    plain = VersionedBars._rows
    monkeypatch.setattr(VersionedBars, "_rows", lambda self, files, kind: opened.append(kind) or plain(self, files, kind))
    batch = large.read(["S0001"]).withColumn("date", F.date_add("date", 500))
    opened.clear()
    assert large.append(batch) == 500
    assert set(opened) == {"meta"}


def test_no_version_column_reaches_the_reader_and_empty_changes_do_nothing(spark, tmp_path):
    table = VersionedBars(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        table.create(frame(spark, []))
    table.create(frame(spark, [("A", 0, 1.0)]))
    for change in (table.append, table.merge, table.replace):
        change(frame(spark, []))
    assert table.version() == 1 and VERSION not in table.read().columns and table.compact() == 0
