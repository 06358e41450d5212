"""Moments, penalised models and exact quantiles against direct computations."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import moments as mo
from barloom.operators.quantiles import exact_quantiles, robust_scaled

RNG = np.random.default_rng(7)
X = RNG.normal(1e6, 3.0, (400, 4)) @ np.diag([1, 2, 0.5, 1]) + RNG.normal(0, 1, (400, 1))
Y = X @ np.array([0.5, -1.0, 2.0, 0.0]) + RNG.normal(0, 0.5, 400)


def whole():
    return mo.Moments.of(np.column_stack([X, Y]))


def test_moments_merge_exactly():
    rows = np.column_stack([X, Y])
    cuts = [0, 1, 1, 7, 200, 400]
    total = mo.Moments.empty(5)
    for a, b in zip(cuts, cuts[1:]):
        total = total + mo.Moments.of(rows[a:b])
    assert total.n == 400 and np.allclose(total.mean, rows.mean(axis=0), rtol=1e-14)
    assert np.allclose(total.m2, np.cov(rows.T, ddof=0) * 400, rtol=1e-9)


def test_least_squares_and_ridge_equal_direct_solutions():
    centred = X - X.mean(axis=0)
    direct = np.linalg.lstsq(centred, Y - Y.mean(), rcond=None)[0]
    assert np.allclose(mo.fit_linear(whole(), "linear").coefficients, direct, atol=1e-8)
    z = centred / X.std(axis=0)
    for alpha in (0.1, 50.0):
        w = np.linalg.solve(z.T @ z + alpha * np.eye(4), z.T @ (Y - Y.mean())) / X.std(axis=0)
        assert np.allclose(mo.fit_linear(whole(), "ridge", alpha).coefficients, w, atol=1e-9)


@pytest.mark.parametrize("name, alpha, ratio", [("lasso", 0.1, 1.0), ("lasso", 5.0, 1.0), ("elastic", 0.5, 0.3), ("elastic", 0.01, 0.9), ("lasso", 1e9, 1.0)])
def test_lasso_and_elastic_net_meet_their_optimality_conditions(name, alpha, ratio):
    model = mo.fit_linear(whole(), name, alpha, ratio)
    scale = X.std(axis=0)
    z, w = (X - X.mean(axis=0)) / scale, model.coefficients * scale
    gradient = z.T @ (Y - Y.mean() - z @ w) / len(Y) - alpha * (1 - ratio) * w
    assert np.all(np.abs(gradient) <= alpha * ratio + 1e-7)
    assert np.allclose(gradient[w != 0], alpha * ratio * np.sign(w[w != 0]), atol=1e-7)
    if alpha == 1e9:
        assert not w.any() and math.isclose(model.intercept, Y.mean())


def test_constant_and_equal_columns():
    rows = np.column_stack([X[:, 0], np.full(400, 3.0), X[:, 0], Y])
    for name in ("linear", "ridge", "lasso"):
        model = mo.fit_linear(mo.Moments.of(rows), name, 0.5)
        assert model.coefficients[1] == 0 and np.isfinite(model.coefficients).all()


def test_error_follows_from_the_moments():
    model = mo.fit_linear(mo.Moments.of(np.column_stack([X, Y])[:300]), "ridge", 2.0)
    direct = np.mean((Y[300:] - model.intercept - X[300:] @ model.coefficients) ** 2)
    assert math.isclose(model.mse(mo.Moments.of(np.column_stack([X, Y])[300:])), direct, rel_tol=1e-6)


@pytest.fixture(scope="module")
def table(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(400)]
    rows = [("A" if i % 2 else "B", days[i], *map(float, X[i]), None if i == 5 else float("nan") if i == 9 else float(Y[i])) for i in range(400)]
    return spark.createDataFrame(rows, "symbol string, date date, x0 double, x1 double, x2 double, x3 double, y double").repartition(7)


def test_parts_are_summarised_in_spark(table):
    found = mo.moments_by_part(table, ["x0", "y"], F.when(F.col("symbol") == "A", 1).when(F.col("x1") > 2e6, 2))
    use = np.array([i % 2 == 1 and i not in (5, 9) for i in range(400)])
    assert set(found) == {1, 2} and found[1].n == use.sum()
    assert np.allclose(found[1].mean, [X[use, 0].mean(), Y[use].mean()], rtol=1e-13)


def test_search_trains_on_the_past_only(table):
    rows = mo.search_linear(table, ["x0", "x1", "x2", "x3"], "y", {"name": ["ridge"], "alpha": [1.0, 100.0]}).collect()
    keep = [i for i in range(400) if i not in (5, 9)]
    edges = np.quantile(keep, [0.25, 0.5, 0.75])
    part = np.array([sum(i >= e for e in edges) for i in keep])
    x, y = X[keep], Y[keep]
    for r in rows:
        model = mo.fit_linear(mo.Moments.of(np.column_stack([x, y])[part <= r["fold"]]), "ridge", float(r["settings"].split("=")[-1]))
        check = part == r["fold"] + 1
        assert r["test_rows"] == check.sum()
        assert math.isclose(r["mse"], np.mean((y[check] - model.intercept - x[check] @ model.coefficients) ** 2), rel_tol=1e-6)


def test_models_per_symbol(table):
    got = {(r["symbol"], r["model"]): r for r in mo.linear_per_symbol(table, ["x0", "x2"], "y", {"a": {"name": "linear"}, "b": {"name": "lasso", "alpha": 0.1}}).collect()}
    assert set(got) == {(s, m) for s in "AB" for m in "ab"}
    own = [i for i in range(0, 400, 2)]
    cut = int(len(own) * 0.8)
    model = mo.fit_linear(mo.Moments.of(np.column_stack([X[:, [0, 2]], Y])[own[:cut]]), "linear")
    assert np.allclose(got["B", "a"]["coefficients"], model.coefficients, atol=1e-9) and got["B", "a"]["test_rows"] == len(own) - cut
    assert mo.linear_per_symbol(table, ["x0"], "y", {"a": {}}, min_rows=300).count() == 0


# --- quantiles ------------------------------------------------------------------------

SETS = {
    "normal": RNG.normal(0, 1, 500).tolist(), "ties": [1.0] * 300 + [2.0] * 100 + [3.0], "huge": [-1.7e308, 1.7e308, 0.0, 1e-300, 5.0],
    "skewed": (10.0 ** RNG.uniform(-200, 200, 300)).tolist(), "one": [4.5], "two": [1.0, 2.0], "close": (1e16 + np.arange(100) * 2).tolist(),
}


@pytest.mark.parametrize("kind", list(SETS))
@pytest.mark.parametrize("bins", [2, 4096])
def test_quantiles_are_exact(spark, kind, bins):
    values = SETS[kind]
    if bins == 2 and len(values) > 120:
        values = values[:60]
    df = spark.createDataFrame([(v, None) for v in values] + [(None, None), (float("nan"), None)], "v double, nothing double").coalesce(2)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, ["v", "nothing"], shares, bins)
    s = sorted(values)
    for q, found in zip(shares, got["v"]):
        at = (len(s) - 1) * q
        a, b = s[math.floor(at)], s[math.ceil(at)]
        assert found == (a if a == b else a + (b - a) * (at - math.floor(at)))
    assert got["nothing"] == [None] * 5


def test_infinite_values_and_a_range_of_zero(spark):
    df = spark.createDataFrame([(float("-inf"), 2.0), (1.0, 2.0), (2.0, 2.0), (float("inf"), 2.0), (3.0, 7.0)], "v double, c double")
    assert exact_quantiles(df, ["v"], [0.0, 0.5, 1.0])["v"] == [float("-inf"), 2.0, float("inf")]
    assert sorted(r["c"] for r in robust_scaled(df, ["c"], []).collect()) == [0.0, 0.0, 0.0, 0.0, 5.0]
