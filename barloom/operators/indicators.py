"""Frame-based indicators. A ``*_recipe`` lists dependency layers; see ``add_layers``."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import corrected_kurtosis, corrected_skewness
from barloom.functions.series import (
    deviation,
    full,
    highest,
    indicator,
    last_rows,
    long_totals,
    lowest,
    mean,
    nxt,
    pct_change,
    prev,
    ratio,
    rolling_correlation,
    series,
    so_far,
    total,
    whole_series,
)

ANNUAL = math.sqrt(252)


def _c(name):
    return F.col(name)


# --- shared helper columns ----------------------------------------------------

def delta():
    return {"__delta": _c("close") - prev("close")}


def simple_return():
    return {"returns": pct_change("close")}


def typical():
    return {"__tp": (_c("high") + _c("low") + _c("close")) / 3}


def prev_bar():
    return {f"__prev_{c}": prev(c) for c in ("close", "high", "low")}


# --- rolling central moments ---------------------------------------------------

def _merged(a, b, na: int, nb: int):
    """Central power sums of two disjoint row sets, each (mean, m2, m3, m4)."""
    (mean_a, a2, a3, a4), (mean_b, b2, b3, b4) = a, b
    n = na + nb
    d = mean_b - mean_a
    return (
        mean_a + d * (nb / n),
        a2 + b2 + d * d * (na * nb / n),
        a3 + b3 + d * d * d * (na * nb * (na - nb) / n**2) + 3 * d * (na * b2 - nb * a2) / n,
        a4 + b4 + d * d * d * d * (na * nb * (na * na - na * nb + nb * nb) / n**3)
        + 6 * d * d * (na * na * b2 + nb * nb * a2) / n**2 + 4 * d * (na * b3 - nb * a3) / n,
    )


def _merge_plan(windows) -> dict[int, tuple[int, int] | None]:
    """How the sums of every window are put together: from the sums of two shorter ones, or (up to 5 rows) directly.

    A window of 5, 10, 20, 40, ... rows is split in halves, any other at the greatest of these below it.
    """
    plan: dict[int, tuple[int, int] | None] = {}

    def need(n):
        if n in plan:
            return
        if n <= DIRECT:
            plan[n] = None
            return
        left = DIRECT
        while 2 * left < n:
            left *= 2
        need(left)
        need(n - left)
        plan[n] = (left, n - left)

    for n in windows:
        if n < 2:
            raise ValueError(f"a window has at least two rows, not {n}")
        need(n)
    return plan


DIRECT = 5


def central_moments(c: str, windows):
    """Layers with mean and central power sums of the last n rows for any windows n.

    Up to five rows are summed directly from lagged values; wider windows merge the
    sums of two disjoint parts, looked up at a lag. That takes a dozen lookups a row
    where a sliding moment aggregate is re-run over the whole frame, and deviations
    are always taken from a local mean, so nothing cancels.
    """
    parts = ("mean", "m2", "m3", "m4")
    plan = _merge_plan(windows)

    def at(n, lag=0):
        names = [f"__{c}_{n}_{p}" for p in parts]
        return [prev(x, lag) if lag else _c(x) for x in names]

    def named(n, values):
        return {f"__{c}_{n}_{p}": v for p, v in zip(parts, values)}

    direct = sorted(n for n in plan if plan[n] is None)
    lags = [f"__{c}_back_{k}" for k in range(1, max(direct))]
    gaps = [_c(x) - _c(c) for x in lags]

    def shift(n):
        return f"__{c}_shift_{n}"

    def center(n):
        return sum(gaps[1:n - 1], gaps[0]) / n if n > 1 else F.when(_c(c).isNotNull(), 0.0)

    def summed(n):
        devs = [-_c(shift(n)), *[g - _c(shift(n)) for g in gaps[:n - 1]]]

        def power(k):
            terms = []
            for d in devs:
                term = d
                for _ in range(k - 1):
                    term = term * d
                terms.append(term)
            return sum(terms[1:], terms[0])

        return named(n, [_c(c) + _c(shift(n)), power(2), power(3), power(4)])

    layers = [
        {x: prev(c, k) for k, x in enumerate(lags, 1)},
        {shift(n): center(n) for n in direct},
        {name: col for n in direct for name, col in summed(n).items()},
    ]
    # Levels: a window comes after both of its parts.
    levels = {n: 0 for n in direct}
    while len(levels) < len(plan):
        ready = {n: 1 + max(levels[x] for x in two) for n, two in plan.items() if n not in levels and all(x in levels for x in two)}
        levels |= ready
    for level in range(1, max(levels.values()) + 1):
        layer = {}
        for n in sorted(k for k, v in levels.items() if v == level):
            left, right = plan[n]
            layer |= named(n, _merged(at(left), at(right, left), left, right))
        layers.append(layer)
    return layers


def moment_deviation(c: str, n: int):
    return F.sqrt(_c(f"__{c}_{n}_m2") / (n - 1))


def merge_recipes(*recipes):
    """One recipe whose layer i holds the layers i of all given recipes."""
    depth = max(len(r) for r in recipes)
    return [
        {name: col for r in recipes if i < len(r) for name, col in r[i].items()} for i in range(depth)
    ]


# --- lags, returns, moving averages -------------------------------------------

def lag_recipe(cols=("close", "volume"), lags=(1, 2, 3, 5, 10)):
    return [{f"{c}_lag_{k}": prev(c, k) for c in cols for k in lags}]


def return_recipe(ks=(1,)):
    return [{f"return_{k}": pct_change("close", k) for k in ks}]


def log_return_recipe(eps=None):
    base = prev("close")
    quotient = ratio("close", base) if eps is None else _c("close") / (base + eps)
    return [{"log_returns": F.ln(quotient)}]


def sma_recipe(windows=(5, 10, 20, 50, 100, 200), col="close"):
    helper, sums = long_totals(col, windows)
    averages = {f"sma_{n}": sums[n] / n for n in windows}
    return [helper, averages] if helper else [averages]


def wma_recipe(windows=(5, 10, 20, 50, 100, 200)):
    """Linear weights 1..n: the rank-weighted sum minus what older ranks over-count."""
    rank = F.row_number().over(series()).cast("double")
    helper, sums = long_totals("close", windows)
    ranked_helper, ranked = long_totals("__rank_close", windows)
    out = {}
    for n in windows:
        weighted = ranked[n] - (_c("__rank") - n) * sums[n]
        out[f"wma_{n}"] = weighted / (n * (n + 1) / 2)
    return [{"__rank": rank, "__rank_close": _c("close") * rank}, helper | ranked_helper, out]


def momentum_recipe(ks=(5, 10)):
    return [{f"momentum_{k}": _c("close") - prev("close", k) for k in ks}]


def roc_recipe(k=10):
    before = prev("close", k)
    return [{f"roc_{k}": ratio(_c("close") - before, before) * 100}]


# --- oscillators --------------------------------------------------------------

def rsi_recipe(windows=(14,), names=None, eps=None):
    """Simple-mean RSI. The first change of a series counts as no change."""
    gain = F.when(_c("__delta") > 0, _c("__delta")).otherwise(0.0)
    loss = F.when(_c("__delta") < 0, -_c("__delta")).otherwise(0.0)
    means, out = {}, {}
    for n in windows:
        g, l = f"__gain_{n}", f"__loss_{n}"
        means |= {g: mean(gain, n), l: mean(loss, n)}
        if eps is not None:
            value = 100 - 100 / (1 + _c(g) / (_c(l) + eps))
        else:
            value = F.when(_c(l) == 0, F.when(_c(g) > 0, 100.0)).otherwise(
                100 - 100 / (1 + ratio(g, l))
            )
        out[(names or {}).get(n, f"rsi_{n}")] = value
    return [delta(), means, out]


def bollinger_recipe(settings=((20, 2.0),)):
    moments = central_moments("close", [n for n, _ in settings])
    bands, shape = {}, {}
    for n, k in settings:
        mid, up, low = f"bb_middle_{n}", f"bb_upper_{n}", f"bb_lower_{n}"
        center, spread = _c(f"__close_{n}_mean"), k * moment_deviation("close", n)
        bands |= {mid: center, up: center + spread, low: center - spread}
        shape |= {
            f"bb_width_{n}": ratio(_c(up) - _c(low), mid),
            f"bb_position_{n}": ratio(_c("close") - _c(low), _c(up) - _c(low)),
        }
    return [*moments, bands, shape]


def squeeze_recipe(settings=((20, 2.0),), q=0.1, window=20):
    """Width below the rolling quantile of itself; false while the window fills."""
    rank = q * (window - 1)
    below, share = int(rank), rank - int(rank)
    sorted_widths, flags = {}, {}
    for n, _ in settings:
        width, vals = f"bb_width_{n}", f"__widths_{n}"
        sorted_widths[vals] = F.sort_array(F.collect_list(width).over(last_rows(window)))
        low, high = _c(vals)[below], _c(vals)[below + 1]
        edge = F.when(F.size(vals) == window, low + share * (high - low))
        flags[f"bb_squeeze_{n}"] = F.coalesce(_c(width) < edge, F.lit(False))
    return [*bollinger_recipe(settings), sorted_widths, flags]


def true_range_recipe(first_row_null=False, name="__tr"):
    span = F.greatest(
        _c("high") - _c("low"),
        F.abs(_c("high") - _c("__prev_close")),
        F.abs(_c("low") - _c("__prev_close")),
    )
    if first_row_null:
        span = F.when(_c("__prev_close").isNotNull(), span)
    return [prev_bar(), {name: span}]


def atr_recipe(n=14):
    return [*true_range_recipe(), {f"atr_{n}": mean("__tr", n)}]


def stochastic_recipe(settings=((14, 3),), slopes=True):
    frames, k_line, after = {}, {}, {}
    for k, d in settings:
        lo, hi, line = f"__low_{k}", f"__high_{k}", f"stoch_k_{k}_{d}"
        frames |= {lo: lowest("low", k), hi: highest("high", k)}
        k_line[line] = 100 * ratio(_c("close") - _c(lo), _c(hi) - _c(lo))
        after[f"stoch_d_{k}_{d}"] = mean(line, d)
        if slopes:
            after[f"stoch_slope_{k}"] = pct_change(line, 2)
    return [frames, k_line, after]


def williams_recipe(windows=(14, 28)):
    frames, out = {}, {}
    for n in windows:
        lo, hi = f"__low_{n}", f"__high_{n}"
        frames |= {lo: lowest("low", n), hi: highest("high", n)}
        out[f"williams_r_{n}"] = -100 * ratio(_c(hi) - _c("close"), _c(hi) - _c(lo))
    return [frames, out]


def _mean_abs_deviation(values: str, center, n: int):
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.abs(x - center)) / n


def cci_recipe(windows=(14, 20)):
    """Commodity channel index; the mean absolute deviation is folded over the frame's values."""
    frames, out = {}, {}
    for n in windows:
        frames |= {
            f"__tp_mean_{n}": mean("__tp", n),
            f"__tp_vals_{n}": F.collect_list("__tp").over(last_rows(n)),
        }
        center = _c(f"__tp_mean_{n}")
        out[f"cci_{n}"] = ratio(
            _c("__tp") - center, 0.015 * _mean_abs_deviation(f"__tp_vals_{n}", center, n)
        )
    return [typical(), frames, out]


def mfi_recipe(windows=(14, 28)):
    """Money flow index; the first bar of a series moves neither way."""
    flow = _c("__tp") * _c("volume")
    up = F.when(_c("__tp") > _c("__prev_tp"), flow).otherwise(0.0)
    down = F.when(_c("__tp") < _c("__prev_tp"), flow).otherwise(0.0)
    sums, out = {}, {}
    for n in windows:
        p, q = f"__flow_up_{n}", f"__flow_down_{n}"
        sums |= {p: total(up, n), q: total(down, n)}
        out[f"mfi_{n}"] = F.when(_c(q) == 0, F.when(_c(p) > 0, 100.0)).otherwise(
            100 - 100 / (1 + ratio(p, q))
        )
    return [typical(), {"__prev_tp": prev("__tp")}, sums, out]


# --- volume -------------------------------------------------------------------

def volume_recipe(n=20, sma=None, name="volume_ratio"):
    sma = sma or f"volume_sma_{n}"
    return [{sma: mean("volume", n)}, {name: ratio("volume", sma)}]


def obv_recipe():
    step = F.coalesce(F.signum("__delta") * _c("volume"), F.lit(0.0))
    return [delta(), {"obv": F.sum(step).over(so_far())}]


def vwap_recipe():
    traded = F.sum(_c("close") * _c("volume")).over(so_far())
    return [
        {"vwap": ratio(traded, F.sum("volume").over(so_far()))},
        {"price_vs_vwap": ratio("close", "vwap") - 1},
    ]


def price_volume_corr_recipe(n=20):
    return [{"price_volume_corr": rolling_correlation("close", "volume", n)}]


# --- price structure ----------------------------------------------------------

def channel_recipe(windows=(20, 50)):
    frames, out = {}, {}
    for n in windows:
        top, base = f"resistance_{n}", f"support_{n}"
        frames |= {top: highest("high", n), base: lowest("low", n)}
        out[f"support_resistance_ratio_{n}"] = ratio(_c("close") - _c(base), _c(top) - _c(base))
    return [frames, out]


def fibonacci_recipe():
    top, base = _c("resistance_20"), _c("support_20")
    span = top - base
    # Retracement shares.
    levels = {"fib_23_6": 0.236, "fib_38_2": 0.382, "fib_61_8": 0.618}
    out = {name: top - share * span for name, share in levels.items()}
    out["fib_position"] = ratio(_c("close") - base, span)
    return [channel_recipe((20,))[0], out]


def directional_recipe(windows=(14, 21, 50)):
    """Directional movement averaged over the true range, aligned row by row."""
    up = _c("high") - _c("__prev_high")
    down = _c("__prev_low") - _c("low")
    moves = {
        "__plus_dm": F.when((up > down) & (up > 0), up).otherwise(0.0),
        "__minus_dm": F.when((down > up) & (down > 0), down).otherwise(0.0),
        **true_range_recipe(first_row_null=True, name="__tr_known")[1],
    }
    frames, di, out = {}, {}, {}
    for n in windows:
        frames |= {
            f"__plus_{n}": mean("__plus_dm", n),
            f"__minus_{n}": mean("__minus_dm", n),
            f"__range_{n}": mean("__tr_known", n),
        }
        di |= {
            f"__di_up_{n}": 100 * ratio(f"__plus_{n}", f"__range_{n}"),
            f"__di_down_{n}": 100 * ratio(f"__minus_{n}", f"__range_{n}"),
        }
        u, d = _c(f"__di_up_{n}"), _c(f"__di_down_{n}")
        out |= {f"adx_{n}": 100 * ratio(F.abs(u - d), u + d), f"di_diff_{n}": u - d}
    return [prev_bar(), moves, frames, di, out]


def candle_recipe():
    """Body and shadow shares of the day's range below a tenth; false for an empty range."""
    span = _c("high") - _c("low")
    body_top, body_base = F.greatest("open", "close"), F.least("open", "close")

    def small(part):
        return F.coalesce(ratio(part, span) < 0.1, F.lit(False))

    return [
        {
            "doji": small(F.abs(_c("open") - _c("close"))),
            "hammer": small(_c("high") - body_top),
            "shooting_star": small(body_base - _c("low")),
        }
    ]


def structure_recipe():
    def rising(c):
        return (_c(c) > prev(c)) & (prev(c) > prev(c, 2))

    def falling(c):
        return (_c(c) < prev(c)) & (prev(c) < prev(c, 2))

    flags = {
        "higher_highs": F.coalesce(rising("high"), F.lit(False)),
        "lower_lows": F.coalesce(falling("low"), F.lit(False)),
    }
    strength = total(_c("higher_highs").cast("int"), 10) - total(_c("lower_lows").cast("int"), 10)
    return [flags, {"trend_strength": strength}]


# --- volatility and moments -----------------------------------------------------

def garman_klass_recipe():
    radicand = F.ln(ratio("high", "low")) * F.ln(ratio("close", "low")) - (
        2 * math.log(2) - 1
    ) * F.pow(F.ln(ratio("close", "open")), F.lit(2.0))
    return [{"garman_klass_vol": F.when(radicand >= 0, ANNUAL * F.sqrt(radicand))}]


def realised_vol_recipe(windows=(10, 20, 50)):
    """Annualised return deviation, its ratio to the 20-row one, and the range deviation."""
    needed = sorted({20, *windows})
    spread = [simple_return() | {"__range": _c("high") - _c("low")}]
    parts = merge_recipes(
        [{}, *central_moments("returns", needed)], [{}, *central_moments("__range", windows)]
    )
    vol = {f"realized_vol_{n}": ANNUAL * moment_deviation("returns", n) for n in needed}
    vol |= {f"range_vol_{n}": moment_deviation("__range", n) for n in windows}
    ratios = {f"volatility_ratio_{n}": ratio(f"realized_vol_{n}", "realized_vol_20") for n in windows}
    return merge_recipes(spread, parts) + [vol, ratios]


def moment_recipe(cols=("close", "returns"), windows=(5, 10, 20)):
    """Bias-corrected rolling skewness and excess kurtosis, for windows of at least four rows."""
    out, recipes = {}, []
    for c in cols:
        recipes.append(central_moments(c, windows))
        for n in windows:
            m2, m3, m4 = (_c(f"__{c}_{n}_m{k}") / n for k in (2, 3, 4))
            varies = m2 > 1e-14
            size = F.lit(float(n))
            skew = F.when(varies, ratio(m3, m2 * F.sqrt(m2)))
            kurt = F.when(varies, ratio(m4, m2 * m2) - 3)
            out[f"{c}_skew_{n}"] = corrected_skewness(skew, size)
            out[f"{c}_kurt_{n}"] = corrected_kurtosis(kurt, size)
    return merge_recipes([simple_return()], *[[{}, *r] for r in recipes]) + [out]


def slope_recipe(base, pairs, k):
    """Adds ``pct_change(k)`` of columns made by the recipe ``base``."""
    return [*base, {out: pct_change(src, k) for src, out in pairs.items()}]


def position_recipe(base, pairs):
    """Adds ``close / column - 1`` for columns made by the recipe ``base``."""
    return [*base, {out: ratio("close", src) - 1 for src, out in pairs.items()}]


def growth_recipe(ret="returns"):
    """Cumulative growth of a return column and its running peak."""
    return [
        {"growth": F.product(1 + _c(ret)).over(so_far())},
        {"peak": F.max("growth").over(so_far())},
    ]


def sequence_recipe(n=60, cols=("close",)):
    """The n scaled rows before each row, oldest first, with the row's own scaled close.

    Scaling maps every column to 0…1 over the symbol's series.
    """
    scaled = {}
    for c in cols:
        lo, hi = F.min(c).over(whole_series()), F.max(c).over(whole_series())
        scaled[f"__scaled_{c}"] = F.coalesce(ratio(_c(c) - lo, hi - lo), F.lit(0.0))
    window = series().rowsBetween(-n, -1)
    steps = F.collect_list(F.array(*[_c(f"__scaled_{c}") for c in cols])).over(window)
    return [
        scaled,
        {"__steps": steps},
        {"sequence": F.when(F.size("__steps") == n, _c("__steps")), "target": _c("__scaled_close")},
    ]


# --- public DataFrame -> DataFrame functions -------------------------------------

def sma(df: DataFrame, n=20, col="close"):
    return indicator(df, sma_recipe((n,), col))


def wma(df: DataFrame, n=20):
    return indicator(df, wma_recipe((n,)))


def rsi(df: DataFrame, n=14):
    return indicator(df, rsi_recipe((n,)))


def bollinger(df: DataFrame, n=20, k=2.0):
    return indicator(df, bollinger_recipe(((n, k),)))


def atr(df: DataFrame, n=14):
    return indicator(df, atr_recipe(n))


def stochastic(df: DataFrame, k=14, d=3):
    return indicator(df, stochastic_recipe(((k, d),)))


def lag_features(df: DataFrame, cols=("close", "volume"), lags=(1, 2, 3, 5, 10)):
    return indicator(df, lag_recipe(cols, lags))


def returns(df: DataFrame, ks=(1, 2, 3, 5)):
    return indicator(df, return_recipe(ks))


def lookback_sequences(df: DataFrame, n=60, cols=("close",)):
    return indicator(df, sequence_recipe(n, cols)).filter(F.col("sequence").isNotNull())


def base_100(df: DataFrame):
    start = F.first("close").over(so_far())
    return df.withColumn("base_100", ratio("close", start) * 100)


def next_close(df: DataFrame):
    return df.withColumn("target", nxt("close"))
