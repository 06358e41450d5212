"""Named feature bundles: every symbol at once, one exchange by symbol.

Bundles with exponential averages are ``blockwise``: all their windows share the order that the
averages need, so the bare bars are sorted once and no wide row is sorted or spilled again.
The averages come first: their windows, a dozen of them, then pass bare bars and not all other columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import cyclical
from barloom.functions.series import (
    add_layers,
    by_symbol,
    mean,
    nxt,
    pct_change,
    prev,
    strip_temps,
)
from barloom.operators import indicators as ind
from barloom.operators.ewm import blockwise, ewm, macd_set

EPS = 1e-10


def _averages_last(df: DataFrame, keep, averaged: DataFrame) -> DataFrame:
    """The columns in the order in which a bundle names them: bars, layers, averages."""
    averages = [c for c in averaged.columns if c not in keep]
    return df.select(*keep, *[c for c in df.columns if c not in averaged.columns], *averages)


def _c(name):
    return F.col(name)


@blockwise
def features_basic(df: DataFrame) -> DataFrame:
    """Averages, momentum, oscillators, bands, volume and channels of the cleaning job."""
    keep = df.columns
    df = averaged = macd_set(
        df, [(12, 26, 9)], named=False, also={f"ema_{n}": ("close", n) for n in (5, 10, 20, 50)}
    )
    channel = [{"high_20": ind.highest("high", 20), "low_20": ind.lowest("low", 20)}]
    df = add_layers(
        df,
        ind.sma_recipe(),
        ind.momentum_recipe(),
        ind.roc_recipe(),
        ind.rsi_recipe((14,)),
        ind.bollinger_recipe(),
        ind.atr_recipe(14),
        ind.stochastic_recipe(((14, 3),), slopes=False),
        ind.volume_recipe(20),
        ind.obv_recipe(),
        channel,
    )
    return _averages_last(strip_temps(df.drop("stoch_d_14_3"), keep), keep, averaged)


@blockwise
def features_forecast(df: DataFrame) -> DataFrame:
    """Inputs of the single-model forecaster, with the next close as ``target``."""
    keep = df.columns
    windows = (5, 10, 20, 50, 200)
    averages = {f"ema_{n}": ("close", n) for n in windows}
    df = averaged = macd_set(df, [(12, 26, 9)], named=False, also=averages).drop("macd_hist")
    df = add_layers(
        df,
        [ind.simple_return() | ind.log_return_recipe()[0] | {"target": nxt("close")}],
        ind.sma_recipe(windows),
        [ind.simple_return(), {"volatility": ind.deviation("returns", 20)}],
        ind.rsi_recipe((14,)),
        ind.bollinger_recipe(),
        ind.volume_recipe(20),
        ind.lag_recipe(("close",)),
        [ind.simple_return(), ind.lag_recipe(("returns",))[0]],
    )
    return _averages_last(strip_temps(df.drop("bb_position_20"), keep), keep, averaged)


def features_ensemble(df: DataFrame) -> DataFrame:
    """The compact feature set of the three-model ensemble."""
    keep = df.columns
    df = add_layers(
        df,
        [ind.simple_return() | {"target": nxt("close")}],
        ind.sma_recipe((5, 20, 50)),
        [ind.simple_return(), {"volatility": ind.deviation("returns", 20)}],
        ind.rsi_recipe((14,)),
        ind.lag_recipe(("close",)),
    )
    return strip_temps(df, keep)


def _trend_recipes():
    return [
        ind.candle_recipe(),
        ind.channel_recipe(),
        ind.directional_recipe(),
        [{"__volume_50": mean("volume", 50)}, {"volume_profile": ind.ratio("volume", "__volume_50")}],
        ind.price_volume_corr_recipe(),
        ind.fibonacci_recipe(),
        ind.structure_recipe(),
    ]


def features_trend(df: DataFrame) -> DataFrame:
    """Candle flags, support and resistance, directional movement, market structure."""
    return strip_temps(add_layers(df, *_trend_recipes()), df.columns)


@blockwise
def features_full(df: DataFrame) -> DataFrame:
    """The comprehensive set: trend features plus every indicator family in several settings."""
    keep = df.columns
    windows = (5, 10, 20, 50, 100, 200)
    macds = [(12, 26, 9), (5, 35, 5), (19, 39, 9)]
    bands = ((20, 2.0), (10, 1.5), (50, 2.5))
    stochs = ((14, 3), (5, 3), (21, 5))
    lags = (1, 2, 3, 5, 10, 20)
    changes = {f"ema_slope_{n}": (f"ema_{n}", 5) for n in windows}
    changes |= {f"macd_slope_{f}_{s}": (f"macd_{f}_{s}", 3) for f, s, _ in macds}
    df = averaged = macd_set(by_symbol(df), macds, also={f"ema_{n}": ("close", n) for n in windows}, changes=changes)
    df = add_layers(
        df,
        *_trend_recipes(),
        [ind.simple_return() | ind.log_return_recipe()[0] | {"target": nxt("close")}],
        ind.garman_klass_recipe(),
        ind.slope_recipe(ind.sma_recipe(windows), {f"sma_{n}": f"sma_slope_{n}" for n in windows}, 5),
        ind.position_recipe(ind.sma_recipe(windows), {f"sma_{n}": f"price_vs_sma_{n}" for n in windows}),
        ind.wma_recipe(windows),
        ind.realised_vol_recipe(),
        ind.slope_recipe(ind.rsi_recipe((7, 14, 21)), {f"rsi_{n}": f"rsi_slope_{n}" for n in (7, 14, 21)}, 3),
        ind.squeeze_recipe(bands),
        ind.stochastic_recipe(stochs),
        ind.williams_recipe(),
        ind.cci_recipe(),
        ind.mfi_recipe(),
        ind.obv_recipe(),
        ind.vwap_recipe(),
        ind.lag_recipe(("close", "volume"), lags),
        [ind.simple_return(), ind.lag_recipe(("returns",), lags)[0]],
        ind.moment_recipe(),
        late=True,
    )
    df = _averages_last(strip_temps(df.drop(*[f"bb_middle_{n}" for n, _ in bands]), keep), keep, averaged)
    return df.withColumns({f"price_vs_ema_{n}": ind.ratio("close", f"ema_{n}") - 1 for n in windows})


@blockwise
def features_universal(df: DataFrame) -> DataFrame:
    """Scale-free features for one pooled model; ratios carry a small epsilon."""
    keep = df.columns
    df = averaged = macd_set(df, [(12, 26, 9)], scale=_c("close") + EPS, named=False)
    averages = {f"__sma_{n}": mean("close", n) for n in (5, 10, 20, 50)}
    ratios = {f"sma_{n}_ratio": _c("close") / (_c(f"__sma_{n}") + EPS) for n in (5, 10, 20, 50)}
    ratios |= {f"sma_{n}_slope": pct_change(f"__sma_{n}", 3) for n in (5, 10, 20, 50)}
    day_range = (_c("high") - _c("low")) / (_c("close") + EPS)
    day_sin, day_cos = cyclical(F.weekday("date"), 7)
    month_sin, month_cos = cyclical(F.month("date"), 12)
    plain = ind.simple_return() | ind.log_return_recipe(eps=EPS)[0] | {
        "high_low_ratio": _c("high") / (_c("low") + EPS),
        "close_open_ratio": _c("close") / (_c("open") + EPS),
        "volume_ma_20": mean("volume", 20),
        "volume_change": pct_change("volume"),
        "day_of_week": F.weekday("date"),
        "day_sin": day_sin,
        "day_cos": day_cos,
        "month": F.month("date"),
        "month_sin": month_sin,
        "month_cos": month_cos,
        "target_price": nxt("close"),
    }
    vols = {f"volatility_{n}": ind.deviation("returns", n) for n in (5, 10, 20)}
    vols |= {f"range_{n}": mean(day_range, n) for n in (5, 10, 20)}
    vols |= {f"returns_lag_{k}": prev("returns", k) for k in (1, 2, 3, 5)}
    vols |= {"volume_ratio": _c("volume") / (_c("volume_ma_20") + EPS), "target_return": nxt("returns")}
    bands = [
        averages | {"__std_20": ind.deviation("close", 20)},
        {"bb_upper": _c("__sma_20") + 2 * _c("__std_20"), "bb_lower": _c("__sma_20") - 2 * _c("__std_20")},
        {
            "bb_position": (_c("close") - _c("bb_lower")) / (_c("bb_upper") - _c("bb_lower") + EPS),
            "bb_width": (_c("bb_upper") - _c("bb_lower")) / (_c("__sma_20") + EPS),
            **{f"volume_ratio_lag_{k}": prev("volume_ratio", k) for k in (1, 2, 3, 5)},
        },
    ]
    df = add_layers(df, [plain, vols], [averages, ratios], bands, ind.rsi_recipe((14,), eps=EPS))
    return _averages_last(strip_temps(df, keep), keep, averaged)


# Universal columns that are not model inputs.
UNIVERSAL_EXCLUDED = ("volume_ma_20", "bb_upper", "bb_lower", "day_of_week", "month")

__all__ = [
    "ewm",
    "features_basic",
    "features_ensemble",
    "features_forecast",
    "features_full",
    "features_trend",
    "features_universal",
]
