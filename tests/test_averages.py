import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import indicators as ind
from barloom.operators.ewm import ema, ewm, macd
from barloom.functions.series import indicator


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(5)
    return list(100 + np.cumsum(rng.normal(0, 1, 1700)) + 60)


def _column(df, name):
    return df.orderBy("symbol", "date").select(name).toPandas()[name]


@pytest.mark.parametrize("span", [1, 2, 12, 200])
def test_average_equals_recurrence_over_several_blocks(make_bars, walk, span):
    got = _column(ema(make_bars({"A": walk}), (span,)), f"ema_{span}")
    want = pd.Series(walk).ewm(span=span, adjust=False).mean()
    assert np.allclose(got, want, rtol=0, atol=1e-9)


def test_constant_series_stays_constant(make_bars):
    got = _column(ema(make_bars({"A": [7.0] * 600}), (20,)), "ema_20")
    assert np.allclose(got, 7.0, atol=1e-12)


def test_macd_signal_is_an_average_of_the_line(make_bars, walk):
    df = macd(make_bars({"A": walk, "B": walk[::-1]})).orderBy("symbol", "date").toPandas()
    for _, part in df.groupby("symbol"):
        c = part["close"]
        line = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
        assert np.allclose(part["macd"], line, atol=1e-9)
        assert np.allclose(part["macd_signal"], line.ewm(span=9, adjust=False).mean(), atol=1e-9)


def _with_gaps(make_bars, values):
    df = make_bars({"A": [0.0 if v is None else v for v in values]})
    wanted = [i for i, v in enumerate(values) if v is None]
    gone = F.datediff("date", F.lit("2020-01-01").cast("date")).isin(wanted) if wanted else F.lit(False)
    return df.withColumn("close", F.when(~gone, F.col("close")))


GAPS = {
    "one": lambda w: [None if i == 2 else v for i, v in enumerate(w[:40])],
    "leading": lambda w: [None if i < 30 else v for i, v in enumerate(w[:90])],
    "every other": lambda w: [None if i % 2 else v for i, v in enumerate(w[:1200])],
    "whole blocks": lambda w: [None if 300 <= i < 1500 else v for i, v in enumerate(w)],
    "trailing": lambda w: [None if i >= 500 else v for i, v in enumerate(w[:700])],
    "random": lambda w: [None if (i * 7919) % 11 < 4 else v for i, v in enumerate(w)],
    "nothing": lambda w: [None] * 50,
}


@pytest.mark.parametrize("kind", list(GAPS))
def test_average_over_gaps_equals_recurrence(make_bars, walk, kind):
    values = GAPS[kind](walk)
    df = ema(_with_gaps(make_bars, values), (1, 2, 12, 200)).orderBy("date").toPandas()
    s = pd.Series(values, dtype=float)
    for span in (1, 2, 12, 200):
        want = s.ewm(span=span, adjust=False).mean()
        assert np.allclose(df[f"ema_{span}"].astype(float), want, rtol=0, atol=1e-9, equal_nan=True), span


def test_null_is_the_identity_of_a_constant_series(make_bars):
    got = _column(ema(_with_gaps(make_bars, [10.0, 10.0, None, 10.0, 10.0]), (3,)), "ema_3")
    assert list(got) == [10.0] * 5


def test_macd_over_gaps(make_bars, walk):
    values = GAPS["random"](walk)
    df = macd(_with_gaps(make_bars, values)).orderBy("date").toPandas()
    s = pd.Series(values, dtype=float)
    line = s.ewm(span=12, adjust=False).mean() - s.ewm(span=26, adjust=False).mean()
    assert np.allclose(df["macd"], line, atol=1e-9, equal_nan=True)
    assert np.allclose(df["macd_signal"], line.ewm(span=9, adjust=False).mean(), atol=1e-9, equal_nan=True)


def test_two_inputs_in_one_pass(make_bars, walk):
    df = ewm(make_bars({"A": walk}), {"c": ("close", 5), "v": (F.col("volume").cast("double"), 9)})
    v = pd.Series(range(100, 100 + len(walk))).ewm(span=9, adjust=False).mean()
    assert np.allclose(_column(df, "v"), v, atol=1e-8)


def test_rolling_moments_equal_pandas(make_bars, walk):
    df = indicator(make_bars({"A": walk}), ind.moment_recipe(("close",)))
    s = pd.Series(walk)
    for n in (5, 10, 20):
        # Window by window: the running pandas versions lose digits themselves.
        skew = s.rolling(n).apply(lambda x: pd.Series(x).skew())
        kurt = s.rolling(n).apply(lambda x: pd.Series(x).kurt())
        assert np.allclose(_column(df, f"close_skew_{n}"), skew, atol=1e-9, equal_nan=True)
        assert np.allclose(_column(df, f"close_kurt_{n}"), kurt, atol=1e-8, equal_nan=True)


def test_moments_of_any_window_equal_pandas(make_bars, walk):
    windows = (4, 6, 7, 23, 30, 63, 250)
    values = [None if i == 700 else v for i, v in enumerate(walk)]
    df = indicator(_with_gaps(make_bars, values), ind.moment_recipe(("close",), windows)).orderBy("date").toPandas()
    s = pd.Series(values, dtype=float)
    for n in windows:
        skew = s.rolling(n).apply(lambda x: pd.Series(x).skew())
        kurt = s.rolling(n).apply(lambda x: pd.Series(x).kurt())
        assert np.allclose(df[f"close_skew_{n}"].astype(float), skew, atol=1e-7, equal_nan=True), n
        assert np.allclose(df[f"close_kurt_{n}"].astype(float), kurt, atol=1e-6, equal_nan=True), n


def test_merge_plans_are_short():
    for n in range(2, 1000):
        plan = ind._merge_plan([n])
        assert len(plan) <= 20 and all(a + b == k for k, two in plan.items() if two for a, b in [two])


def test_long_sums_equal_plain_rolling(make_bars, walk):
    df = indicator(make_bars({"A": walk}), ind.sma_recipe((5, 20, 50, 100, 200)))
    for n in (5, 20, 50, 100, 200):
        assert np.allclose(_column(df, f"sma_{n}"), pd.Series(walk).rolling(n).mean(), atol=1e-9, equal_nan=True)
    wma = indicator(make_bars({"A": walk}), ind.wma_recipe((50,)))
    weights = np.arange(1, 51)
    want = pd.Series(walk).rolling(50).apply(lambda x: np.average(x, weights=weights))
    assert np.allclose(_column(wma, "wma_50"), want, atol=1e-6, equal_nan=True)
