"""Readers, the store and incremental jobs on small literal files."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import learning as ml
from barloom.schema import BARS
from barloom.sources import files, store
from barloom.streaming import jobs

PLAIN = "Date,Open,High,Low,Close,Volume\n2020-01-02,1,2,0.5,1.5,100\n2020-01-01,1,2,0.5,1.25,90\nbad,1,2,3,4,5\n2020-01-03,x,2,1,1,7\n2020-01-04,1,2,1,1,\n2020-01-02,9,9,9,9,9\n"
THREE = "Price,Close,High,Low,Open,Volume\nTicker,B.NS,B.NS,B.NS,B.NS,B.NS\nDate,,,,,\n2020-01-01,5,6,4,4.5,10\n2020-01-02,6,7,5,5.5,11\n"
TICKER = "Date,Adj Close,Close,High,Low,Open,Volume\n,C.NS,C.NS,C.NS,C.NS,C.NS,C.NS\n2020-01-01,7.5,8,9,7,7.7,20\n"


@pytest.fixture()
def drop(tmp_path):
    folder = tmp_path / "eod"
    folder.mkdir()
    for name, text in (("AAA", PLAIN), ("BBB", THREE), ("CCC", TICKER)):
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


def test_three_header_layouts(spark, drop):
    got = {(r["symbol"], str(r["date"])): (r["open"], r["close"], r["volume"]) for r in files.read_bars_csv(spark, drop).collect()}
    assert got == {
        ("AAA", "2020-01-01"): (1.0, 1.25, 90), ("AAA", "2020-01-02"): (9.0, 9.0, 9),
        ("BBB", "2020-01-01"): (4.5, 5.0, 10), ("BBB", "2020-01-02"): (5.5, 6.0, 11),
        ("CCC", "2020-01-01"): (7.7, 8.0, 20),
    }
    first = files.read_bars_csv(spark, drop, keep="first").filter("symbol = 'AAA' and date = '2020-01-02'").first()
    assert first["close"] == 1.5
    assert {r["symbol"] for r in files.read_bars_csv(spark, drop, min_rows=2).collect()} == {"AAA", "BBB"}


def test_master_history_and_strategies(spark, tmp_path):
    (tmp_path / "m.csv").write_text("SYMBOL,NAME\nAAA,a\n BBB ,b\nAAA,a\n")
    assert {r["symbol"] for r in files.read_symbol_master(spark, str(tmp_path / "m.csv")).collect()} == {"AAA", "BBB"}
    doc = {"A": {"2024-01-05": {"predicted_price": 11.0, "current_price": 10.0, "predicted_change": 10.0, "confidence": 80.0,
                                "model": "m", "validated": True, "validation": {"accuracy": 97.0, "status": "accurate"}},
                 "2024-01-06": {"predicted_price": 1.0, "current_price": 1.0, "predicted_change": 0.0, "confidence": 1.0, "model": "m"}}}
    (tmp_path / "h.json").write_text(json.dumps(doc, indent=2))
    rows = files.read_forecast_history(spark, str(tmp_path / "h.json")).orderBy("made_on").collect()
    assert [r["validated"] for r in rows] == [True, False] and rows[0]["validation"]["status"] == "accurate"
    book = files.read_strategies(spark)
    files.write_strategies(book, str(tmp_path / "s"))
    again = files.read_strategies(spark, str(tmp_path / "s"))
    assert sorted(map(tuple, again.select(*book.columns).collect())) == sorted(map(tuple, book.collect()))


def rows_of(symbol, first, last, close=1.0):
    return [(symbol, dt.date(2020, 1, d), 1.0, 2.0, 0.5, close + d, 10) for d in range(first, last + 1)]


def test_store_append_is_idempotent_and_per_symbol(spark, tmp_path):
    path = str(tmp_path / "bars")
    store.write_bars(spark.createDataFrame(rows_of("A", 1, 10) + rows_of("B", 1, 3), BARS), path, 4)
    incoming = spark.createDataFrame(rows_of("A", 8, 12, 100.0) + rows_of("B", 2, 5, 100.0) + rows_of("N", 1, 2), BARS)
    for _ in range(2):
        store.append_pending(spark, path, incoming, 4)
        got = store.read_bars(spark, path)
        assert got.count() == 12 + 5 + 2
        assert got.filter("close > 100").count() == 4
    assert store.read_bars(spark, path, "B", 4).count() == 5


def test_store_refresh_replaces_whole_series(spark, tmp_path):
    path = str(tmp_path / "bars")
    store.write_bars(spark.createDataFrame(rows_of("A", 1, 10) + rows_of("B", 1, 3) + rows_of("C", 1, 4), BARS), path, 2)
    from pyspark.sql import functions as F

    fresh = spark.createDataFrame(rows_of("A", 5, 6) + rows_of("A", 6, 6, 50.0), BARS)
    store.refresh_stored_symbols(spark, path, fresh.withColumn("seq", F.col("close")), "seq", 2)
    got = store.read_bars(spark, path)
    assert sorted((r["symbol"], r["date"].day, r["close"]) for r in got.filter("symbol = 'A'").collect()) == [("A", 5, 6.0), ("A", 6, 56.0)]
    assert got.filter("symbol <> 'A'").count() == 7
    out = str(tmp_path / "kept")
    store.write_retained(spark, path, out, 2, buckets=2)
    assert store.read_bars(spark, out).agg(F.min("date")).first()[0] == dt.date(2020, 1, 4)


def test_streams_over_several_batches_equal_batch(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "ema")
    book = str(tmp_path / "bars")
    rng = np.random.default_rng(1)
    prices = 50 + np.cumsum(rng.normal(0, 1, 30))
    store.write_bars(spark.createDataFrame([], BARS), book, 2)
    rows = [("A", dt.date(2020, 1, 1) + dt.timedelta(days=i), 1.0, 1.0, 1.0, float(p), 1) for i, p in enumerate(prices)]
    for lo, hi in ((0, 10), (8, 20), (20, 30)):  # the second file repeats two days
        spark.createDataFrame(rows[lo:hi], BARS).coalesce(1).write.mode("append").parquet(source)
        stream = lambda: jobs.bar_stream(spark, source, BARS)
        jobs.stream_to_table(jobs.stream_ema(stream(), 5), target, str(tmp_path / "c1")).awaitTermination()
        jobs.stream_ingest(jobs.without_repeats(stream()), book, str(tmp_path / "c3"), 2).awaitTermination()
    got = spark.read.parquet(target).orderBy("date").toPandas()
    want = pd.Series(prices).ewm(span=5, adjust=False).mean()
    assert np.allclose(got["ema"], want) and len(got) == 30
    assert store.read_bars(spark, book).count() == 30


def test_running_metadata_updates(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "meta")
    for part in (rows_of("A", 1, 4), rows_of("A", 5, 6) + rows_of("B", 1, 1)):
        spark.createDataFrame(part, BARS).write.mode("append").parquet(source)
        stream = jobs.running_metadata(jobs.bar_stream(spark, source, BARS))
        jobs.stream_to_table(stream, target, str(tmp_path / "c"), mode="update").awaitTermination()
    got = {r["symbol"]: (r["record_count"], r["last_date"].day, r["last_close"]) for r in jobs.newest_batch_per_symbol(spark, target).collect()}
    assert got == {"A": (6, 6, 7.0), "B": (1, 1, 2.0)}


def test_per_symbol_ridge_against_normal_equations(spark, make_bars):
    from barloom.operators.clean import feature_columns
    from barloom.plans.features import features_ensemble

    rng = np.random.default_rng(9)
    b = make_bars({"A": 100 + np.cumsum(rng.normal(0, 1, 200)), "short": [1.0] * 50})
    df = features_ensemble(b)
    feats = feature_columns(df)
    got = ml.fit_per_symbol(df, feats).collect()
    assert [r["symbol"] for r in got] == ["A"]
    pdf = df.filter("symbol = 'A'").orderBy("date").toPandas().dropna()
    cut = int(len(pdf) * 0.8)
    x, y = pdf[feats].to_numpy(), pdf["target"].to_numpy()
    z = (x - x[:cut].mean(0)) / x[:cut].std(0)
    w = np.linalg.solve(z[:cut].T @ z[:cut] + np.eye(len(feats)), z[:cut].T @ (y[:cut] - y[:cut].mean()))
    guess = z[cut:] @ w + y[:cut].mean()
    assert got[0]["mape"] == pytest.approx(np.mean(np.abs((y[cut:] - guess) / y[cut:])) * 100)
    assert np.allclose(got[0]["coefficients"], w)


def test_interactions_have_no_powers(spark):
    crossed = ml.interaction_columns(ml.POLYNOMIAL_INPUTS, 3)
    assert len(crossed) + len(ml.POLYNOMIAL_INPUTS) == 231
    assert all(len(set(name.split("_x_"))) == len(name.split("_x_")) for name in crossed)


def test_the_polynomial_stores_its_inputs_and_not_their_products(spark, monkeypatch):
    names = [f"x{i}" for i in range(4)]
    rows = spark.range(200).select(*[F.sin(F.col("id") * (i + 1)).alias(n) for i, n in enumerate(names)])
    rows = rows.withColumn("target", 2 + F.col("x0") * F.col("x1") * 3)
    stored = []
    kept = ml.materialised
    monkeypatch.setattr(ml, "materialised", lambda df, *a: stored.append(df.columns) or kept(df, *a))
    model, metrics = ml.fit_polynomial(rows, rows, inputs=names, alpha=1e-6)
    assert stored == [["label", *names]]
    assert model.numFeatures == 4 + 6 + 4 and metrics.first()["mse"] < 1e-9


def test_every_arrival_is_a_run_of_its_own(spark, monkeypatch):
    from catalog import streams
    from catalog.registry import QUERIES

    runs = []
    begin = streams.jobs.stream_into_versions
    monkeypatch.setattr(streams.jobs, "stream_into_versions", lambda *a, **k: runs.append(a) or begin(*a, **k))
    QUERIES["streamed_version_state"](spark, "/root/testdata/sf0.001")
    assert len(runs) == 4
