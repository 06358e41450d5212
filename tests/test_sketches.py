"""Sketches merge to what one sketch of everything gives, within the stated bounds; the ensemble survives saving."""

import numpy as np
from pyspark.sql import functions as F

from barloom.operators import learning as ml
from barloom.operators import sketches as sk


def _bars(spark, n=20_000, symbols=700):
    return spark.range(n).select(
        F.format_string("S%d", F.col("id") % symbols).alias("symbol"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 100).cast("int")).alias("date"),
        F.rand(3).alias("close"))


def test_statistics_within_bounds_and_parts_add_up(spark):
    df = _bars(spark)
    month = F.trunc("date", "month")
    older, newer = df.filter("date < '2020-03-10'"), df.filter("date >= '2020-03-10'")
    parts = sk.merged(sk.sketch(older, month), sk.sketch(newer, month))
    assert parts.count() == df.select(month).distinct().count()
    row = sk.statistics(parts).first()
    assert (row["total_records"], str(row["min_date"])) == (20_000, "2020-01-01")
    assert abs(row["total_stocks"] - 700) <= sk.SYMBOL_BOUND * 700
    for q in (25, 50, 75):
        assert abs(row[f"close_q{q}"] - q / 100) <= sk.RANK_BOUND
    some = sk.statistics(parts.filter("part = DATE '2020-02-01'")).first()
    assert some["total_records"] == df.filter(month == F.lit("2020-02-01").cast("date")).count()


def test_empty_table_has_no_parts(spark):
    empty = _bars(spark).limit(0)
    assert sk.sketch(empty, F.trunc("date", "month")).count() == 0


def test_ensemble_is_saved_with_its_weights_and_features(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (300, 2))
    y = x @ np.array([1.0, -2.0]) + rng.normal(0, 0.1, 300)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    fitted = ml.fit(df, ["a", "b"], "y", {"ridge": {}, "lasso": {"alpha": 0.05}})
    fitted = ml.weigh(fitted, ml.evaluate(fitted, df))
    fitted.save(str(tmp_path / "m"), spark)
    again = ml.FittedModels.load(str(tmp_path / "m"), spark)
    assert (again.features, again.label, again.weights, list(again.models)) == (fitted.features, "y", fitted.weights, ["ridge", "lasso"])
    guess = lambda m, rows: [r[0] for r in m.transform(rows).select(ml.combined(m)).collect()]
    assert np.allclose(guess(again, df), guess(fitted, df), atol=1e-12)
    # A feature the table lacks counts as 0.
    assert np.allclose(guess(again, df.drop("b")), guess(fitted, df.withColumn("b", F.lit(0.0))), atol=1e-12)
