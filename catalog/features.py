"""Window indicators and feature bundles."""

from pyspark.sql import functions as F

from barloom.functions.series import add_layers, indicator, strip_temps
from barloom.operators import backtest as bt
from barloom.operators import indicators as ind
from barloom.operators.ewm import ema, macd, macd_set
from barloom.plans import features as bundles
from catalog.registry import (
    BARS, NUMBERED, SERIES, SO_FAR, TAME, W, bars, div, ema_cte, frame, full, gapped_ema_cte, lag, layers, lead, low,
    mean, pct, register, statement, std, tame, top, total,
)

KEY = "symbol, date"


def _sql(steps, numbers, plain=KEY, base=BARS, digits=6):
    ctes, last = layers("bars", *steps)
    return statement([base, *ctes], last, plain, numbers, digits)


def _pick(df, *names):
    return df.select("symbol", "date", *names)


def add(name, recipe, steps, numbers, flags=(), digits=6, source=bars, base=BARS):
    """Register one indicator: a function giving its recipe, and its SQL as layers and output columns."""
    names = list(numbers)
    plain = ", ".join([KEY, *flags])

    def run(spark, d):
        return _pick(indicator(source(spark, d), recipe()), *names, *flags)

    register(name, _sql(steps, numbers, plain, base, digits), digits)(run)


# --- lags and averages -----------------------------------------------------------

LAGS = (1, 2, 3, 5, 10)
add("lag_features", lambda: ind.lag_recipe(), [{"one": "1"}],
    {f"{c}_lag_{k}": lag(c, k) for c in ("close", "volume") for k in LAGS})
add("next_close", lambda: [{"target": ind.nxt("close")}], [{"one": "1"}], {"target": lead("close")})
add("simple_returns", lambda: ind.return_recipe((1, 2, 3, 5)), [{"one": "1"}],
    {f"return_{k}": pct("close", k) for k in (1, 2, 3, 5)})
add("log_returns", lambda: ind.log_return_recipe(), [{"one": "1"}], {"log_returns": f"ln({div('close', lag('close'))})"})
add("simple_moving_averages", lambda: ind.sma_recipe(), [{"one": "1"}],
    {f"sma_{n}": mean("close", n) for n in (5, 10, 20, 50, 100, 200)})


def _wma(n):
    weights = f"sum(close * rn) OVER {frame(n)} - (rn - {n}) * sum(close) OVER {frame(n)}"
    return f"CASE WHEN count(close) OVER {frame(n)} = {n} THEN ({weights}) / ({n} * ({n} + 1) / 2.0) END"


add("weighted_moving_averages", lambda: ind.wma_recipe(), [{"rn": f"row_number() OVER {W}"}],
    {f"wma_{n}": _wma(n) for n in (5, 10, 20, 50, 100, 200)})
add("momentum", lambda: ind.momentum_recipe(), [{"one": "1"}],
    {f"momentum_{k}": f"close - {lag('close', k)}" for k in (5, 10)})
add("rate_of_change", lambda: ind.roc_recipe(), [{"one": "1"}],
    {"roc_10": f"{div('close - ' + lag('close', 10), lag('close', 10))} * 100"})

EMA_SPANS = (5, 10, 20, 50, 100, 200)
register(
    "exponential_moving_averages",
    statement([BARS, NUMBERED, *[ema_cte(f"e{n}", "numbered", "close", n) for n in EMA_SPANS]],
              "numbered n " + " ".join(f"JOIN e{n} USING (symbol, rn)" for n in EMA_SPANS), KEY,
              {f"ema_{n}": f"e{n}.y" for n in EMA_SPANS}),
)(lambda spark, d: _pick(ema(bars(spark, d), EMA_SPANS), *[f"ema_{n}" for n in EMA_SPANS]))


# A quarter of the closes missing, chosen by the bar's volume.
GAPPED = ("numbered AS (SELECT * REPLACE (CASE WHEN volume % 4 <> 1 THEN close END AS close), "
          f"row_number() OVER {W} AS rn FROM bars)")


def _gapped(spark, d):
    return bars(spark, d).withColumn("close", F.when(F.col("volume") % 4 != 1, F.col("close")))


register(
    "exponential_moving_averages_with_gaps",
    statement([BARS, GAPPED, *[gapped_ema_cte(f"e{n}", "numbered", "close", n) for n in EMA_SPANS]],
              "numbered n " + " ".join(f"JOIN e{n} USING (symbol, rn)" for n in EMA_SPANS), KEY,
              {f"ema_{n}": f"e{n}.y" for n in EMA_SPANS}),
)(lambda spark, d: _pick(ema(_gapped(spark, d), EMA_SPANS), *[f"ema_{n}" for n in EMA_SPANS]))

register(
    "macd_with_gaps",
    statement([BARS, GAPPED, gapped_ema_cte("x12", "numbered", "close", 12), gapped_ema_cte("x26", "numbered", "close", 26),
               "line AS (SELECT symbol, rn, x12.y - x26.y AS macd FROM x12 JOIN x26 USING (symbol, rn))", gapped_ema_cte("sig", "line", "macd", 9)],
              "numbered n JOIN line USING (symbol, rn) JOIN sig USING (symbol, rn)", KEY,
              {"macd": "line.macd", "macd_signal": "sig.y", "macd_hist": "line.macd - sig.y"}),
)(lambda spark, d: _pick(macd(_gapped(spark, d)), "macd", "macd_signal", "macd_hist"))


def _macd_ctes(settings, scale=""):
    ctes = [NUMBERED]
    spans = sorted({s for f, s_, _ in settings for s in (f, s_)})
    ctes += [ema_cte(f"x{n}", "numbered", "close", n) for n in spans]
    for f, s, g in settings:
        ctes.append(
            f"line{f} AS (SELECT n.symbol, n.rn, (a.y - b.y){scale} AS macd FROM numbered n "
            f"JOIN x{f} a USING (symbol, rn) JOIN x{s} b USING (symbol, rn))"
        )
        ctes.append(ema_cte(f"sig{f}", f"line{f}", "macd", g))
    return ctes


def _macd_from(settings):
    return "numbered n " + " ".join(
        f"JOIN line{f} USING (symbol, rn) JOIN sig{f} USING (symbol, rn)" for f, _, _ in settings
    )


ONE = [(12, 26, 9)]
MACDS = [(12, 26, 9), (5, 35, 5), (19, 39, 9)]
register(
    "macd",
    statement([BARS, *_macd_ctes(ONE)], _macd_from(ONE), KEY,
              {"macd": "line12.macd", "macd_signal": "sig12.y", "macd_hist": "line12.macd - sig12.y"}),
)(lambda spark, d: _pick(macd(bars(spark, d)), "macd", "macd_signal", "macd_hist"))


def _macd_numbers():
    out = {}
    for f, s, g in MACDS:
        out[f"macd_{f}_{s}"] = f"line{f}.macd"
        out[f"macd_signal_{f}_{s}_{g}"] = f"sig{f}.y"
        out[f"macd_hist_{f}_{s}_{g}"] = f"line{f}.macd - sig{f}.y"
    return out


register("macd_variants", statement([BARS, *_macd_ctes(MACDS)], _macd_from(MACDS), KEY, _macd_numbers()))(
    lambda spark, d: _pick(macd_set(bars(spark, d), MACDS), *_macd_numbers())
)

# --- oscillators -------------------------------------------------------------------

DELTA = {"delta": f"close - {lag('close')}"}
GAINS = {"gain": "CASE WHEN delta > 0 THEN delta ELSE 0 END", "loss": "CASE WHEN delta < 0 THEN -delta ELSE 0 END"}


def _rsi_means(windows):
    return {f"g{n}": mean("gain", n) for n in windows} | {f"l{n}": mean("loss", n) for n in windows}


def _rsi(n):
    return (f"CASE WHEN l{n} = 0 THEN CASE WHEN g{n} > 0 THEN 100 END "
            f"ELSE 100 - 100 / (1 + g{n} / l{n}) END")


RSI_STEPS = [DELTA, GAINS, _rsi_means((7, 14, 21)), {f"rsi_{n}": _rsi(n) for n in (7, 14, 21)}]
add("rsi", lambda: ind.slope_recipe(ind.rsi_recipe((7, 14, 21)), {f"rsi_{n}": f"rsi_slope_{n}" for n in (7, 14, 21)}, 3),
    RSI_STEPS, {f"rsi_{n}": f"rsi_{n}" for n in (7, 14, 21)} | {f"rsi_slope_{n}": pct(f"rsi_{n}", 3) for n in (7, 14, 21)})

BANDS = ((20, 2.0), (10, 1.5), (50, 2.5))
BB_STEPS = [
    {f"bb_middle_{n}": mean("close", n) for n, _ in BANDS} | {f"sd{n}": std("close", n) for n, _ in BANDS},
    {f"bb_upper_{n}": f"bb_middle_{n} + {k} * sd{n}" for n, k in BANDS}
    | {f"bb_lower_{n}": f"bb_middle_{n} - {k} * sd{n}" for n, k in BANDS},
    {f"bb_width_{n}": div(f"bb_upper_{n} - bb_lower_{n}", f"bb_middle_{n}") for n, _ in BANDS}
    | {f"bb_position_{n}": div(f"close - bb_lower_{n}", f"bb_upper_{n} - bb_lower_{n}") for n, _ in BANDS},
]
add("bollinger_bands", lambda: ind.bollinger_recipe(BANDS), BB_STEPS,
    {c: c for n, _ in BANDS for c in (f"bb_middle_{n}", f"bb_upper_{n}", f"bb_lower_{n}", f"bb_width_{n}", f"bb_position_{n}")})
add("bollinger_squeeze", lambda: ind.squeeze_recipe(BANDS),
    [*BB_STEPS,
     {f"edge{n}": full(20, f"quantile_cont(bb_width_{n}, 0.1)", f"bb_width_{n}") for n, _ in BANDS},
     {f"bb_squeeze_{n}": f"coalesce(bb_width_{n} < edge{n}, false)" for n, _ in BANDS}],
    {}, flags=[f"bb_squeeze_{n}" for n, _ in BANDS])


def _band_steps(bands):
    return [
        {f"bb_middle_{n}": mean("close", n) for n, _ in bands} | {f"sd{n}": std("close", n) for n, _ in bands},
        {f"bb_upper_{n}": f"bb_middle_{n} + {k} * sd{n}" for n, k in bands}
        | {f"bb_lower_{n}": f"bb_middle_{n} - {k} * sd{n}" for n, k in bands},
        {f"bb_width_{n}": div(f"bb_upper_{n} - bb_lower_{n}", f"bb_middle_{n}") for n, _ in bands},
    ]


ANY = (7, 30, 63)
ANY_BANDS = tuple((n, 2.0) for n in ANY)
add("bollinger_any_window", lambda: ind.squeeze_recipe(ANY_BANDS, window=13),
    [*_band_steps(ANY_BANDS),
     {f"edge{n}": full(13, f"quantile_cont(bb_width_{n}, 0.1)", f"bb_width_{n}") for n in ANY},
     {f"bb_squeeze_{n}": f"coalesce(bb_width_{n} < edge{n}, false)" for n in ANY}],
    {c: c for n in ANY for c in (f"bb_middle_{n}", f"bb_upper_{n}", f"bb_lower_{n}", f"bb_width_{n}")}, flags=[f"bb_squeeze_{n}" for n in ANY])

PREV = {"pc": lag("close"), "ph": lag("high"), "pl": lag("low")}
TR = "greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0))"
add("average_true_range", lambda: ind.atr_recipe(14), [PREV, {"tr": TR}], {"atr_14": mean("tr", 14)})

STOCH = ((14, 3), (5, 3), (21, 5))
add("stochastic", lambda: ind.stochastic_recipe(STOCH),
    [{f"lo{k}": low("low", k) for k, _ in STOCH} | {f"hi{k}": top("high", k) for k, _ in STOCH},
     {f"stoch_k_{k}_{d}": f"100 * {div(f'close - lo{k}', f'hi{k} - lo{k}')}" for k, d in STOCH}],
    {f"stoch_k_{k}_{d}": f"stoch_k_{k}_{d}" for k, d in STOCH}
    | {f"stoch_d_{k}_{d}": mean(f"stoch_k_{k}_{d}", d) for k, d in STOCH}
    | {f"stoch_slope_{k}": pct(f"stoch_k_{k}_{d}", 2) for k, d in STOCH}, digits=5)
add("williams_r", lambda: ind.williams_recipe(), [{f"lo{n}": low("low", n) for n in (14, 28)} | {f"hi{n}": top("high", n) for n in (14, 28)}],
    {f"williams_r_{n}": f"-100 * {div(f'hi{n} - close', f'hi{n} - lo{n}')}" for n in (14, 28)})
add("commodity_channel_index", lambda: ind.cci_recipe(),
    [{"tp": "(high + low + close) / 3"},
     {f"m{n}": mean("tp", n) for n in (14, 20)} | {f"v{n}": f"list(tp) OVER {frame(n)}" for n in (14, 20)},
     {f"mad{n}": f"list_sum(list_transform(v{n}, lambda x: abs(x - m{n}))) / {n}" for n in (14, 20)}],
    {f"cci_{n}": div(f"tp - m{n}", f"0.015 * mad{n}") for n in (14, 20)})
add("money_flow_index", lambda: ind.mfi_recipe(),
    [{"tp": "(high + low + close) / 3"}, {"ptp": lag("tp")},
     {"up": "CASE WHEN tp > ptp THEN tp * volume ELSE 0 END", "down": "CASE WHEN tp < ptp THEN tp * volume ELSE 0 END"},
     {f"p{n}": total("up", n) for n in (14, 28)} | {f"q{n}": total("down", n) for n in (14, 28)}],
    {f"mfi_{n}": f"CASE WHEN q{n} = 0 THEN CASE WHEN p{n} > 0 THEN 100 END ELSE 100 - 100 / (1 + p{n} / q{n}) END" for n in (14, 28)})

# --- volume --------------------------------------------------------------------------

add("volume_ratios", lambda: ind.merge_recipes(ind.volume_recipe(20, name="volume_ratio_20"), ind.volume_recipe(50, name="volume_ratio_50")),
    [{f"volume_sma_{n}": mean("volume", n) for n in (20, 50)}],
    {f"volume_sma_{n}": f"volume_sma_{n}" for n in (20, 50)} | {f"volume_ratio_{n}": div("volume", f"volume_sma_{n}") for n in (20, 50)})
add("on_balance_volume", lambda: ind.obv_recipe(), [DELTA, {"step": "coalesce(sign(delta) * volume, 0)"}],
    {"obv": f"sum(step) OVER {SO_FAR}"})
add("volume_weighted_price", lambda: ind.vwap_recipe(),
    [{"vwap": f"sum(close * volume) OVER {SO_FAR} / sum(volume) OVER {SO_FAR}"}],
    {"vwap": "vwap", "price_vs_vwap": "close / vwap - 1"})
add("price_volume_correlation", lambda: ind.price_volume_corr_recipe(), [{"one": "1"}],
    {"price_volume_corr": full(20, "corr(close, volume)", "close")})

# --- structure -------------------------------------------------------------------------

CHANNELS = {f"resistance_{n}": top("high", n) for n in (20, 50)} | {f"support_{n}": low("low", n) for n in (20, 50)}
add("price_channels", lambda: ind.channel_recipe(), [CHANNELS],
    {c: c for c in CHANNELS} | {f"support_resistance_ratio_{n}": div(f"close - support_{n}", f"resistance_{n} - support_{n}") for n in (20, 50)})
add("fibonacci_levels", lambda: ind.fibonacci_recipe(), [{"r": top("high", 20), "s": low("low", 20)}],
    {"fib_23_6": "r - 0.236 * (r - s)", "fib_38_2": "r - 0.382 * (r - s)", "fib_61_8": "r - 0.618 * (r - s)",
     "fib_position": div("close - s", "r - s")})
DM = (14, 21, 50)
DM_STEPS = [
    PREV,
    {"up": "high - ph", "down": "pl - low", "tr": f"CASE WHEN pc IS NOT NULL THEN {TR} END"},
    {"plus": "CASE WHEN up > down AND up > 0 THEN up ELSE 0 END", "minus": "CASE WHEN down > up AND down > 0 THEN down ELSE 0 END"},
    {f"{a}{n}": mean(x, n) for n in DM for a, x in (("p", "plus"), ("m", "minus"), ("a", "tr"))},
    {f"dp{n}": f"100 * {div(f'p{n}', f'a{n}')}" for n in DM} | {f"dm{n}": f"100 * {div(f'm{n}', f'a{n}')}" for n in DM},
]
add("directional_movement", lambda: ind.directional_recipe(), DM_STEPS,
    {f"adx_{n}": f"100 * {div(f'abs(dp{n} - dm{n})', f'dp{n} + dm{n}')}" for n in DM} | {f"di_diff_{n}": f"dp{n} - dm{n}" for n in DM})
CANDLE_SQL = {
    "doji": f"coalesce({div('abs(open - close)', 'high - low')} < 0.1, false)",
    "hammer": f"coalesce({div('high - greatest(open, close)', 'high - low')} < 0.1, false)",
    "shooting_star": f"coalesce({div('least(open, close) - low', 'high - low')} < 0.1, false)",
}
add("candle_flags", lambda: ind.candle_recipe(), [CANDLE_SQL], {}, flags=list(CANDLE_SQL))
HH = {"higher_highs": f"coalesce(high > {lag('high')} AND {lag('high')} > {lag('high', 2)}, false)",
      "lower_lows": f"coalesce(low < {lag('low')} AND {lag('low')} < {lag('low', 2)}, false)"}
add("market_structure", lambda: ind.structure_recipe(),
    [HH, {"hi": "CAST(higher_highs AS INTEGER)", "li": "CAST(lower_lows AS INTEGER)"},
     {"trend_strength": f"CAST({total('hi', 10)} - {total('li', 10)} AS BIGINT)"}],
    {}, flags=["higher_highs", "lower_lows", "trend_strength"])

# --- volatility, moments, slopes ----------------------------------------------------------

RET = {"returns": pct("close")}
RAD = "ln(high / low) * ln(close / low) - (2 * ln(2) - 1) * pow(ln(close / open), 2)"
add("garman_klass_volatility", lambda: ind.garman_klass_recipe(), [{"rad": RAD}],
    {"garman_klass_vol": "CASE WHEN rad >= 0 THEN sqrt(252) * sqrt(rad) END"})
RV = (10, 20, 50)
add("realised_volatility", lambda: ind.realised_vol_recipe(),
    [RET | {"span": "high - low"}, {f"realized_vol_{n}": f"sqrt(252) * {std('returns', n)}" for n in RV}],
    {f"realized_vol_{n}": f"realized_vol_{n}" for n in RV} | {f"range_vol_{n}": std("span", n) for n in RV}
    | {f"volatility_ratio_{n}": div(f"realized_vol_{n}", "realized_vol_20") for n in RV})


def _moment(kind, x, n):
    return f"CASE WHEN count({x}) OVER {frame(n)} = {n} THEN {kind}({x}) OVER {frame(n)} END"


add("rolling_moments", lambda: ind.moment_recipe(), [RET],
    {f"{c}_{short}_{n}": _moment(kind, c, n) for c in ("close", "returns") for n in (5, 10, 20)
     for short, kind in (("skew", "skewness"), ("kurt", "kurtosis"))}, digits=5, source=tame, base=TAME)
add("realised_volatility_any_window", lambda: ind.realised_vol_recipe(ANY),
    [RET | {"span": "high - low"}, {f"realized_vol_{n}": f"sqrt(252) * {std('returns', n)}" for n in (*ANY, 20)}],
    {f"realized_vol_{n}": f"realized_vol_{n}" for n in ANY} | {f"range_vol_{n}": std("span", n) for n in ANY}
    | {f"volatility_ratio_{n}": div(f"realized_vol_{n}", "realized_vol_20") for n in ANY})
add("rolling_moments_any_window", lambda: ind.moment_recipe(windows=(7, 30, 63)), [RET],
    {f"{c}_{short}_{n}": _moment(kind, c, n) for c in ("close", "returns") for n in ANY
     for short, kind in (("skew", "skewness"), ("kurt", "kurtosis"))}, digits=5, source=tame, base=TAME)
add("intrabar_ratios", lambda: [{"high_low_ratio": F.col("high") / (F.col("low") + 1e-10), "close_open_ratio": F.col("close") / (F.col("open") + 1e-10)}],
    [{"one": "1"}], {"high_low_ratio": "high / (low + 1e-10)", "close_open_ratio": "close / (open + 1e-10)"})
SMAS = (5, 10, 20, 50)
add("average_slopes",
    lambda: ind.slope_recipe(ind.position_recipe(ind.sma_recipe(SMAS), {f"sma_{n}": f"price_vs_sma_{n}" for n in SMAS}), {f"sma_{n}": f"sma_slope_{n}" for n in SMAS}, 5),
    [{f"sma_{n}": mean("close", n) for n in SMAS}],
    {f"price_vs_sma_{n}": div("close", f"sma_{n}") + " - 1" for n in SMAS} | {f"sma_slope_{n}": pct(f"sma_{n}", 5) for n in SMAS})
add("growth_and_peak", lambda: [ind.simple_return(), *ind.growth_recipe()],
    [RET, {"growth": f"product(1 + returns) OVER {SO_FAR}"}],
    {"growth": "growth", "peak": f"max(growth) OVER {SO_FAR}"}, source=tame, base=TAME)
add("base_100_prices", lambda: [{"base_100": F.try_divide("close", F.first("close").over(ind.so_far())) * 100}], [{"one": "1"}],
    {"base_100": f"close / first_value(close) OVER {W} * 100"})

register(
    "lookback_sequences",
    statement(
        [BARS, f"""s AS (SELECT *, (close - min(close) OVER {SERIES}) / nullif(max(close) OVER {SERIES} - min(close) OVER {SERIES}, 0) AS x FROM bars),
          q AS (SELECT symbol, date, x, count(*) OVER p AS n, sum(x) OVER p AS sx,
            first_value(x) OVER p AS oldest, last_value(x) OVER p AS newest
            FROM s WINDOW p AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))"""],
        "q", KEY, {"steps": "n", "total": "sx", "oldest": "oldest", "newest": "newest", "target": "x"}, where="WHERE n = 60"),
)(lambda spark, d: ind.lookback_sequences(bars(spark, d)).select(
    "symbol", "date", F.size("sequence").cast("double").alias("steps"),
    F.aggregate("sequence", F.lit(0.0), lambda acc, x: acc + x[0]).alias("total"),
    F.col("sequence")[0][0].alias("oldest"), F.col("sequence")[59][0].alias("newest"), "target"))

# --- bundles ------------------------------------------------------------------------------

BASIC_STEPS = [
    DELTA | PREV | {f"sma_{n}": mean("close", n) for n in (5, 10, 20, 50, 100, 200)}
    | {"sd20": std("close", 20), "lo14": low("low", 14), "hi14": top("high", 14), "volume_sma_20": mean("volume", 20)},
    GAINS | {"tr": TR, "step": "coalesce(sign(delta) * volume, 0)", "bb_upper_20": "sma_20 + 2 * sd20", "bb_lower_20": "sma_20 - 2 * sd20"},
    _rsi_means((14,)),
]
BASIC_NUMBERS = (
    {f"sma_{n}": f"sma_{n}" for n in (5, 10, 20, 50, 100, 200)}
    | {"momentum_5": f"close - {lag('close', 5)}", "momentum_10": f"close - {lag('close', 10)}",
       "roc_10": f"{div('close - ' + lag('close', 10), lag('close', 10))} * 100", "rsi_14": _rsi(14),
       "bb_middle_20": "sma_20", "bb_upper_20": "bb_upper_20", "bb_lower_20": "bb_lower_20",
       "bb_width_20": div("bb_upper_20 - bb_lower_20", "sma_20"),
       "bb_position_20": div("close - bb_lower_20", "bb_upper_20 - bb_lower_20"),
       "atr_14": mean("tr", 14), "stoch_k_14_3": f"100 * {div('close - lo14', 'hi14 - lo14')}",
       "volume_sma_20": "volume_sma_20", "volume_ratio": div("volume", "volume_sma_20"),
       "obv": f"sum(step) OVER {SO_FAR}", "high_20": top("high", 20), "low_20": low("low", 20)}
    | {f"ema_{n}": f"e{n}.y" for n in (5, 10, 20, 50)}
    | {"macd": "line12.macd", "macd_signal": "sig12.y", "macd_hist": "line12.macd - sig12.y"}
)


def _bundle_sql(steps, numbers, spans, settings=ONE, scale=""):
    """Statement joining frame layers (made over ``numbered``) with exponential averages."""
    ctes, last = layers("numbered", *steps)
    macd_ctes = _macd_ctes(settings, scale)
    extra = [ema_cte(f"e{n}", "numbered", "close", n) for n in spans]
    joins = " ".join(f"JOIN e{n} USING (symbol, rn)" for n in spans)
    joins += " " + " ".join(f"JOIN line{f} USING (symbol, rn) JOIN sig{f} USING (symbol, rn)" for f, _, _ in settings)
    return statement([BARS, *macd_ctes, *extra, *ctes], f"{last} {joins}", KEY, numbers)


register("features_basic", _bundle_sql(BASIC_STEPS, BASIC_NUMBERS, (5, 10, 20, 50)))(
    lambda spark, d: _pick(bundles.features_basic(bars(spark, d)), *BASIC_NUMBERS))

FC = (5, 10, 20, 50, 200)
FORECAST_STEPS = [
    DELTA | RET | {f"sma_{n}": mean("close", n) for n in FC} | {"sd20": std("close", 20), "volume_sma_20": mean("volume", 20)},
    GAINS | {"bb_upper_20": "sma_20 + 2 * sd20", "bb_lower_20": "sma_20 - 2 * sd20"},
    _rsi_means((14,)),
]
FORECAST_NUMBERS = (
    {"returns": "returns", "log_returns": f"ln({div('close', lag('close'))})", "volatility": std("returns", 20), "rsi_14": _rsi(14),
     "macd": "line12.macd", "macd_signal": "sig12.y", "bb_middle_20": "sma_20", "bb_upper_20": "bb_upper_20",
     "bb_lower_20": "bb_lower_20", "bb_width_20": div("bb_upper_20 - bb_lower_20", "sma_20"),
     "volume_sma_20": "volume_sma_20", "volume_ratio": div("volume", "volume_sma_20"), "target": lead("close")}
    | {f"sma_{n}": f"sma_{n}" for n in FC} | {f"ema_{n}": f"e{n}.y" for n in FC}
    | {f"{c}_lag_{k}": lag(c, k) for c in ("close", "returns") for k in LAGS}
)
register("features_forecast", _bundle_sql(FORECAST_STEPS, FORECAST_NUMBERS, FC))(
    lambda spark, d: _pick(bundles.features_forecast(bars(spark, d)), *FORECAST_NUMBERS))

ENSEMBLE_NUMBERS = (
    {"returns": "returns", "sma_5": mean("close", 5), "sma_20": mean("close", 20), "sma_50": mean("close", 50),
     "volatility": std("returns", 20), "rsi_14": _rsi(14), "target": lead("close")}
    | {f"close_lag_{k}": lag("close", k) for k in LAGS}
)
register("features_ensemble", _sql([DELTA | RET, GAINS, _rsi_means((14,))], ENSEMBLE_NUMBERS))(
    lambda spark, d: _pick(bundles.features_ensemble(bars(spark, d)), *ENSEMBLE_NUMBERS))

TREND_STEPS = [*DM_STEPS[:1], CANDLE_SQL | HH | DM_STEPS[1] | CHANNELS,
               DM_STEPS[2] | {"hi": "CAST(higher_highs AS INTEGER)", "li": "CAST(lower_lows AS INTEGER)"},
               DM_STEPS[3] | {"trend_strength": f"CAST({total('hi', 10)} - {total('li', 10)} AS BIGINT)"}, DM_STEPS[4]]
TREND_NUMBERS = (
    {c: c for c in CHANNELS}
    | {f"support_resistance_ratio_{n}": div(f"close - support_{n}", f"resistance_{n} - support_{n}") for n in (20, 50)}
    | {f"adx_{n}": f"100 * {div(f'abs(dp{n} - dm{n})', f'dp{n} + dm{n}')}" for n in DM} | {f"di_diff_{n}": f"dp{n} - dm{n}" for n in DM}
    | {"volume_profile": div("volume", mean("volume", 50)), "price_volume_corr": full(20, "corr(close, volume)", "close"),
       "fib_23_6": "resistance_20 - 0.236 * (resistance_20 - support_20)",
       "fib_38_2": "resistance_20 - 0.382 * (resistance_20 - support_20)",
       "fib_61_8": "resistance_20 - 0.618 * (resistance_20 - support_20)",
       "fib_position": div("close - support_20", "resistance_20 - support_20")}
)
TREND_FLAGS = [*CANDLE_SQL, *HH, "trend_strength"]
register("features_trend", _sql(TREND_STEPS, TREND_NUMBERS, ", ".join([KEY, *TREND_FLAGS])))(
    lambda spark, d: _pick(bundles.features_trend(bars(spark, d)), *TREND_NUMBERS, *TREND_FLAGS))


UNIVERSAL_STEPS = [
    DELTA | RET | {f"s{n}": mean("close", n) for n in SMAS} | {"sd20": std("close", 20), "volume_ma_20": mean("volume", 20),
                                                              "day_range": "(high - low) / (close + 1e-10)"},
    GAINS | {"bb_upper": "s20 + 2 * sd20", "bb_lower": "s20 - 2 * sd20", "volume_ratio": "volume / (volume_ma_20 + 1e-10)"},
    _rsi_means((14,)),
]
UNIVERSAL_NUMBERS = (
    {"returns": "returns", "log_returns": f"ln(close / ({lag('close')} + 1e-10))", "high_low_ratio": "high / (low + 1e-10)",
     "close_open_ratio": "close / (open + 1e-10)", "volume_ma_20": "volume_ma_20", "volume_ratio": "volume_ratio",
     "volume_change": pct("volume"), "rsi_14": "100 - 100 / (1 + g14 / (l14 + 1e-10))",
     "macd": "line12.macd", "macd_signal": "sig12.y", "macd_hist": "line12.macd - sig12.y",
     "bb_upper": "bb_upper", "bb_lower": "bb_lower", "bb_position": "(close - bb_lower) / (bb_upper - bb_lower + 1e-10)",
     "bb_width": "(bb_upper - bb_lower) / (s20 + 1e-10)",
     "day_sin": "sin(2 * pi() * (isodow(date) - 1) / 7)", "day_cos": "cos(2 * pi() * (isodow(date) - 1) / 7)",
     "month_sin": "sin(2 * pi() * month(date) / 12)", "month_cos": "cos(2 * pi() * month(date) / 12)",
     "target_return": lead("returns"), "target_price": lead("close")}
    | {f"sma_{n}_ratio": f"close / (s{n} + 1e-10)" for n in SMAS} | {f"sma_{n}_slope": pct(f"s{n}", 3) for n in SMAS}
    | {f"volatility_{n}": std("returns", n) for n in (5, 10, 20)} | {f"range_{n}": mean("day_range", n) for n in (5, 10, 20)}
    | {f"{c}_lag_{k}": lag(c, k) for c in ("returns", "volume_ratio") for k in (1, 2, 3, 5)}
)
register("features_universal", _bundle_sql(UNIVERSAL_STEPS, UNIVERSAL_NUMBERS, (), scale=" / (n.close + 1e-10)"))(
    lambda spark, d: _pick(bundles.features_universal(bars(spark, d)), *UNIVERSAL_NUMBERS))


# The comprehensive bundle: all layers above side by side, three MACD settings.
FULL_EMAS = (5, 10, 20, 50, 100, 200)
FULL_STEPS = [
    {**PREV, **DELTA, **RET, "tp": "(high + low + close) / 3", "rad": RAD, "span": "high - low",
     "vwap": f"sum(close * volume) OVER {SO_FAR} / sum(volume) OVER {SO_FAR}",
     **{f"sma_{n}": mean("close", n) for n in FULL_EMAS}, **{f"wma_{n}": _wma(n) for n in FULL_EMAS},
     **{f"sd{n}": std("close", n) for n, _ in BANDS},
     **{f"lo{n}": low("low", n) for n in (5, 14, 21, 28)}, **{f"hi{n}": top("high", n) for n in (5, 14, 21, 28)}},
    {**CANDLE_SQL, **HH, **DM_STEPS[1], **CHANNELS, **GAINS, "ptp": lag("tp"), "step": "coalesce(sign(delta) * volume, 0)",
     **{f"bb_upper_{n}": f"sma_{n} + {k} * sd{n}" for n, k in BANDS}, **{f"bb_lower_{n}": f"sma_{n} - {k} * sd{n}" for n, k in BANDS},
     **{f"stoch_k_{k}_{d}": f"100 * {div(f'close - lo{k}', f'hi{k} - lo{k}')}" for k, d in STOCH},
     **{f"m{n}": mean("tp", n) for n in (14, 20)}, **{f"v{n}": f"list(tp) OVER {frame(n)}" for n in (14, 20)},
     **{f"realized_vol_{n}": f"sqrt(252) * {std('returns', n)}" for n in RV}},
    {**DM_STEPS[2], **_rsi_means((7, 14, 21)), "hi": "CAST(higher_highs AS INTEGER)", "li": "CAST(lower_lows AS INTEGER)",
     "up_flow": "CASE WHEN tp > ptp THEN tp * volume ELSE 0 END", "down_flow": "CASE WHEN tp < ptp THEN tp * volume ELSE 0 END",
     **{f"mad{n}": f"list_sum(list_transform(v{n}, lambda x: abs(x - m{n}))) / {n}" for n in (14, 20)},
     **{f"bb_width_{n}": div(f"bb_upper_{n} - bb_lower_{n}", f"sma_{n}") for n, _ in BANDS}},
    {**{f"pm{a}{n}": mean(x, n) for n in DM for a, x in (("p", "plus"), ("m", "minus"), ("a", "tr"))},
     **{f"rsi_{n}": _rsi(n) for n in (7, 14, 21)}, "trend_strength": f"CAST({total('hi', 10)} - {total('li', 10)} AS BIGINT)",
     **{f"fp{n}": total("up_flow", n) for n in (14, 28)}, **{f"fq{n}": total("down_flow", n) for n in (14, 28)},
     **{f"edge{n}": full(20, f"quantile_cont(bb_width_{n}, 0.1)", f"bb_width_{n}") for n, _ in BANDS}},
    {**{f"dp{n}": f"100 * {div(f'pmp{n}', f'pma{n}')}" for n in DM}, **{f"dm{n}": f"100 * {div(f'pmm{n}', f'pma{n}')}" for n in DM},
     **{f"bb_squeeze_{n}": f"coalesce(bb_width_{n} < edge{n}, false)" for n, _ in BANDS}},
]
FULL_NUMBERS = {
    **TREND_NUMBERS, "returns": "returns", "log_returns": f"ln({div('close', lag('close'))})",
    "garman_klass_vol": "CASE WHEN rad >= 0 THEN sqrt(252) * sqrt(rad) END", "vwap": "vwap", "price_vs_vwap": "close / vwap - 1",
    "obv": f"sum(step) OVER {SO_FAR}", "target": lead("close"),
    **{f"{a}_{n}": f"{a}_{n}" for n in FULL_EMAS for a in ("sma", "wma")}, **{f"ema_{n}": f"e{n}.y" for n in FULL_EMAS},
    **{f"price_vs_sma_{n}": div("close", f"sma_{n}") + " - 1" for n in FULL_EMAS},
    **{f"price_vs_ema_{n}": f"close / e{n}.y - 1" for n in FULL_EMAS},
    **{f"sma_slope_{n}": pct(f"sma_{n}", 5) for n in FULL_EMAS}, **{f"ema_slope_{n}": pct(f"e{n}.y", 5) for n in FULL_EMAS},
    **_macd_numbers(), **{f"macd_slope_angle_{f}_{s}": f"atan({pct(f'line{f}.macd', 3)})" for f, s, _ in MACDS},
    **{f"realized_vol_{n}": f"realized_vol_{n}" for n in RV}, **{f"range_vol_{n}": std("span", n) for n in RV},
    **{f"volatility_ratio_{n}": div(f"realized_vol_{n}", "realized_vol_20") for n in RV},
    **{f"rsi_{n}": f"rsi_{n}" for n in (7, 14, 21)}, **{f"rsi_slope_{n}": pct(f"rsi_{n}", 3) for n in (7, 14, 21)},
    **{c: c for n, _ in BANDS for c in (f"bb_upper_{n}", f"bb_lower_{n}", f"bb_width_{n}")},
    **{f"bb_position_{n}": div(f"close - bb_lower_{n}", f"bb_upper_{n} - bb_lower_{n}") for n, _ in BANDS},
    **{f"stoch_k_{k}_{d}": f"stoch_k_{k}_{d}" for k, d in STOCH}, **{f"stoch_d_{k}_{d}": mean(f"stoch_k_{k}_{d}", d) for k, d in STOCH},
    **{f"williams_r_{n}": f"-100 * {div(f'hi{n} - close', f'hi{n} - lo{n}')}" for n in (14, 28)},
    **{f"cci_{n}": div(f"tp - m{n}", f"0.015 * mad{n}") for n in (14, 20)},
    **{f"mfi_{n}": f"CASE WHEN fq{n} = 0 THEN CASE WHEN fp{n} > 0 THEN 100 END ELSE 100 - 100 / (1 + fp{n} / fq{n}) END" for n in (14, 28)},
    **{f"{c}_lag_{k}": lag(c, k) for c in ("close", "volume", "returns") for k in (1, 2, 3, 5, 10, 20)},
    **{f"returns_{short}_{n}": _moment(kind, "returns", n) for n in (5, 10, 20) for short, kind in (("skew", "skewness"), ("kurt", "kurtosis"))},
}
FULL_FLAGS = [*TREND_FLAGS, *[f"bb_squeeze_{n}" for n, _ in BANDS]]


def _full_sql():
    ctes, last = layers("numbered", *FULL_STEPS)
    joins = " ".join(f"JOIN e{n} USING (symbol, rn)" for n in FULL_EMAS)
    joins += " " + " ".join(f"JOIN line{f} USING (symbol, rn) JOIN sig{f} USING (symbol, rn)" for f, _, _ in MACDS)
    extra = [ema_cte(f"e{n}", "numbered", "close", n) for n in FULL_EMAS]
    return statement([BARS, *_macd_ctes(MACDS), *extra, *ctes], f"{last} {joins}", ", ".join([KEY, *FULL_FLAGS]), FULL_NUMBERS, 5)


@register("features_full", _full_sql(), 5)
def _(spark, d):
    df = bundles.features_full(bars(spark, d))
    # A MACD line crosses zero, so its relative slope is unbounded; its angle is compared.
    angles = {f"macd_slope_angle_{f}_{s}": F.atan(f"macd_slope_{f}_{s}") for f, s, _ in MACDS}
    return _pick(df.withColumns(angles), *FULL_NUMBERS, *FULL_FLAGS)
