"""Market screens, summaries and statistics."""

from pyspark.sql import functions as F

from barloom.operators import forecast as fc
from barloom.operators import screens as sc
from barloom.operators import sketches as sk
from barloom.operators import validation as val
from barloom.shared import fresh_path
from catalog.registry import (
    BARS, DESC, FORECAST_CTE, SERIES, TAME, W, as_of, bars, div, forecasts, frame, lag, layers, mean, pct, register,
    statement, tame,
)

NEWEST = "(SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem)"


def _recent(days):
    return f"""recent AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.symbol ORDER BY b.date DESC) AS rn
  FROM bars b JOIN (SELECT symbol, max(date) AS last FROM bars GROUP BY symbol) m USING (symbol)
  WHERE b.date >= m.last - {days})"""


@register("recent_ranked_bars", statement([BARS, _recent(60)], "recent", "symbol, date, rn", ["close"], where="WHERE rn <= 32"))
def _(spark, d):
    return sc.recent_ranked(bars(spark, d)).filter("rn <= 32").select("symbol", "date", F.col("rn").cast("long").alias("rn"), "close")


OFFSETS = {"today_close": 1, **{n: k + 1 for n, k in sc.CLOSE_OFFSETS.items()}}
PIVOT_SQL = """wide AS (SELECT symbol, max(CASE WHEN rn = 1 THEN date END) AS today_date,
  max(CASE WHEN rn = 1 THEN open END) AS today_open, max(CASE WHEN rn = 1 THEN high END) AS today_high,
  max(CASE WHEN rn = 1 THEN low END) AS today_low, max(CASE WHEN rn = 1 THEN volume END) AS volume,
  {closes} FROM recent WHERE rn <= 32 GROUP BY symbol)""".format(
    closes=", ".join(f"max(CASE WHEN rn = {k} THEN close END) AS {n}" for n, k in OFFSETS.items())
)
PIVOT_NUMBERS = ["today_open", "today_high", "today_low", *OFFSETS]


@register("recent_pivot", statement([BARS, _recent(365), PIVOT_SQL], "wide", "symbol, today_date, volume", PIVOT_NUMBERS))
def _(spark, d):
    return sc.recent_pivot(bars(spark, d), lookback_days=365)


YEAR_SQL = f"""year AS (SELECT symbol, max(high) AS week_52_high, min(low) AS week_52_low, avg(volume) AS avg_volume
  FROM bars WHERE date >= {NEWEST} - 365 GROUP BY symbol)"""


@register("year_stats", statement([BARS, YEAR_SQL], "year", "symbol", ["week_52_high", "week_52_low", "avg_volume"]))
def _(spark, d):
    return sc.year_stats(bars(spark, d), as_of(spark, d))


@register("recent_pivot_with_year_stats",
          statement([BARS, _recent(60), PIVOT_SQL, YEAR_SQL], "wide LEFT JOIN year USING (symbol)",
                    "symbol, today_date", ["today_close", "week_52_high", "week_52_low", "avg_volume"]))
def _(spark, d):
    b = bars(spark, d)
    joined = sc.recent_pivot(b).join(sc.year_stats(b, as_of(spark, d)), "symbol", "left")
    return joined.select("symbol", "today_date", "today_close", "week_52_high", "week_52_low", "avg_volume")


PCT_SQL = {n: f"coalesce(({a} - {b}) / nullif({b}, 0) * 100, 0)" for n, (a, b) in sc.SCREEN_CHANGES.items()}
SCREEN_NUMBERS = {n: n for n in [*PIVOT_NUMBERS, "week_52_high", "week_52_low", "avg_volume"]}
SCREEN_NUMBERS["today_change"] = "today_close - day1_close"
SCREEN_ROUNDED = {
    **{n: f"round({e}, 2)" for n, e in PCT_SQL.items()},
    "intraday_change": "round((today_close - today_open) / nullif(today_open, 0) * 100, 2)",
    "volume_ratio": "round(volume / nullif(avg_volume, 0), 2)",
    "week_52_position": "round((today_close - week_52_low) / nullif(week_52_high - week_52_low, 0) * 100, 1)",
}


def _screen_sql(days, tail=""):
    return statement([BARS, _recent(days), PIVOT_SQL, YEAR_SQL], "wide LEFT JOIN year USING (symbol)",
                     "symbol, today_date, volume", SCREEN_NUMBERS | SCREEN_ROUNDED, tail=tail)


@register("market_screen", _screen_sql(60))
def market_screen(spark, d):
    return sc.market_screen(bars(spark, d), as_of(spark, d))


@register("market_screen_year", _screen_sql(365))
def _(spark, d):
    return sc.market_screen(bars(spark, d), as_of(spark, d), lookback_days=365)


@register("market_screen_page", _screen_sql(365, "ORDER BY round(coalesce((today_close - day7_close) / day7_close * 100, 0), 2) DESC NULLS LAST, symbol LIMIT 25 OFFSET 25"))
def _(spark, d):
    return sc.market_screen(bars(spark, d), as_of(spark, d), lookback_days=365, sort_by="week_7day_pct",
                            ascending=False, page_number=2, per_page=25)


@register("screen_page_info", "SELECT count(DISTINCT l_suppkey) AS total_rows, CAST(ceil(count(DISTINCT l_suppkey) / 30.0) AS BIGINT) AS total_pages FROM lineitem")
def _(spark, d):
    return sc.page_info(sc.symbol_list(bars(spark, d)), 30)


FC_COLS = ["predicted_price", "predicted_change_pct", "confidence"]


@register(
    "screen_with_forecasts",
    statement(
        [TAME, FORECAST_CTE, _recent(60), PIVOT_SQL, YEAR_SQL,
         "newest AS (SELECT * FROM forecasts WHERE (symbol, prediction_date) IN (SELECT symbol, max(prediction_date) FROM forecasts GROUP BY symbol))"],
        "wide LEFT JOIN year USING (symbol) LEFT JOIN newest f USING (symbol)", "symbol, today_date, volume, f.model_used",
        ["today_close", "week_52_high", *FC_COLS]),
)
def _(spark, d):
    prices = tame(spark, d)
    made = forecasts(spark, d)
    out = sc.screen_with_forecasts(sc.market_screen(prices, as_of(spark, d)), val.predictions_on(made))
    return out.select("symbol", "today_date", "volume", "model_used", "today_close", "week_52_high", *FC_COLS)


LAST_SQL = f"""ranked AS (SELECT *, row_number() OVER {DESC} AS rn FROM bars),
last AS (SELECT symbol, max(CASE WHEN rn = 1 THEN close END) AS price, max(CASE WHEN rn = 1 THEN volume END) AS volume,
  max(CASE WHEN rn = 2 THEN close END) AS c1, max(CASE WHEN rn = 3 THEN close END) AS c2,
  max(CASE WHEN rn = 6 THEN close END) AS c5, max(CASE WHEN rn = 22 THEN close END) AS c21,
  max(CASE WHEN rn <= 252 THEN high END) AS high_52w, min(CASE WHEN rn <= 252 THEN low END) AS low_52w
  FROM ranked GROUP BY symbol)"""


def _chg(a, b):
    return f"coalesce(({a} - {b}) / nullif({b}, 0) * 100, 0)"


@register("row_year_range", statement([BARS, LAST_SQL], "last", "symbol", ["high_52w", "low_52w"]))
def _(spark, d):
    return sc.last_bar_summary(bars(spark, d)).select("symbol", "high_52w", "low_52w")


@register(
    "criteria_filter",
    statement([BARS, LAST_SQL], "last", "symbol, volume",
              {"price": "price", "returns_1d": _chg("price", "c1"), "returns_5d": _chg("price", "c5"),
               "returns_1m": _chg("price", "c21"), "high_52w": "high_52w", "low_52w": "low_52w"},
              where=f"WHERE price >= 1000 AND price <= 3000 AND volume >= 10 AND {_chg('price', 'c1')} >= -20 AND {_chg('price', 'c21')} >= -25",
              tail=f"ORDER BY {_chg('price', 'c1')} DESC, symbol LIMIT 50"),
)
def _(spark, d):
    criteria = {"price_min": 1000, "price_max": 3000, "volume_min": 10, "returns_1d_min": -20, "returns_1m_min": -25}
    return sc.filter_symbols(bars(spark, d), criteria)


@register("near_year_high",
          statement([BARS, LAST_SQL], "last", "symbol",
                    {"price": "price", "high_52w": "high_52w", "low_52w": "low_52w",
                     "distance_from_high": "(price - high_52w) / high_52w * 100"},
                    where="WHERE (price - high_52w) / high_52w * 100 > -70"))
def _(spark, d):
    return sc.near_high(bars(spark, d), within_pct=70)


@register("yesterday_change", statement([BARS, LAST_SQL], "last", "symbol", {"yesterday_change": _chg("c1", "c2")}))
def _(spark, d):
    return sc.yesterday_change(bars(spark, d))


DETAIL = f"detail AS (SELECT * FROM bars WHERE date >= {NEWEST} - 730)"


@register("symbol_detail_series",
          statement([BARS, DETAIL], "detail", "symbol, date, volume",
                    {c: c for c in ("open", "high", "low", "close")}
                    | {"returns_pct": f"{pct('close')} * 100", "ma_20": mean("close", 20), "ma_50": mean("close", 50)}))
def _(spark, d):
    return sc.detail_series(bars(spark, d), "2y", as_of(spark, d))


TREND_CTES, TREND_LAST = layers(
    "bars", {"delta": f"close - {lag('close')}", "sma_20": mean("close", 20), "sma_50": mean("close", 50), "rn": f"row_number() OVER {DESC}"},
    {"gain": "CASE WHEN delta > 0 THEN delta ELSE 0 END", "loss": "CASE WHEN delta < 0 THEN -delta ELSE 0 END"},
    {"g": mean("gain", 14), "l": mean("loss", 14)},
    {"rsi_14": "CASE WHEN l = 0 THEN CASE WHEN g > 0 THEN 100 END ELSE 100 - 100 / (1 + g / l) END"},
)


@register(
    "trend_states",
    statement([BARS, *TREND_CTES], TREND_LAST,
              """symbol, date, CASE WHEN rsi_14 > 70 THEN 'overbought' WHEN rsi_14 < 30 THEN 'oversold' ELSE 'neutral' END AS rsi_zone,
              CASE WHEN close > sma_20 AND sma_20 > sma_50 THEN 'bullish' WHEN close < sma_20 AND sma_20 < sma_50 THEN 'bearish' ELSE 'none' END AS trend""",
              ["close", "rsi_14", "sma_20", "sma_50"], where="WHERE rn = 1"),
)
def _(spark, d):
    return sc.trend_states(bars(spark, d))


# --- statistics ----------------------------------------------------------------------

@register(
    "summary_card",
    statement(
        [BARS, f"r AS (SELECT *, row_number() OVER {DESC} AS rn, {lag('close')} AS pc, {pct('close')} AS ret FROM bars)",
         """c AS (SELECT symbol, max(CASE WHEN rn = 1 THEN close END) AS latest_price, max(CASE WHEN rn = 1 THEN open END) AS open_price,
         max(CASE WHEN rn = 1 THEN high END) AS high_price, max(CASE WHEN rn = 1 THEN low END) AS low_price,
         max(CASE WHEN rn = 1 THEN pc END) AS before, max(CASE WHEN rn <= 252 THEN high END) AS high_52w,
         min(CASE WHEN rn <= 252 THEN low END) AS low_52w, stddev_samp(ret) AS daily_volatility,
         avg(volume) AS avg_volume, max(CASE WHEN rn = 1 THEN volume END) AS latest_volume FROM r GROUP BY symbol)"""],
        "c", "symbol, latest_volume",
        {n: n for n in ("latest_price", "open_price", "high_price", "low_price", "high_52w", "low_52w", "daily_volatility", "avg_volume")}
        | {"change": "latest_price - before", "change_pct": "(latest_price - before) / before * 100",
           "annual_volatility": "daily_volatility * sqrt(252)"}),
)
def _(spark, d):
    return sc.summary_card(bars(spark, d))


STATS = "SELECT count(*) AS total_records, count(DISTINCT symbol) AS total_stocks, min(date) AS min_date, max(date) AS max_date FROM bars"


@register("table_stats", f"WITH {BARS} {STATS}")
def _(spark, d):
    return sc.table_stats(bars(spark, d))


@register("table_stats_approximate")
def _(spark, d):
    return sc.table_stats(bars(spark, d), approximate=True)


@register("sketched_table_stats", statement(BARS, "bars", """count(*) AS total_records, min(date) AS min_date, max(date) AS max_date,
  true AS symbols_within_bound, true AS quantiles_within_bound"""))
def _(spark, d):
    """Sketches by month of the older bars, kept as a table; newer bars are added without reading the older ones again."""
    df = bars(spark, d)
    month = F.trunc("date", "month")
    path = fresh_path(spark, "sketches")
    sk.sketch(df.filter("date < DATE '1997-01-15'"), month).write.parquet(path)
    r = sk.statistics(sk.merged(spark.read.parquet(path), sk.sketch(df.filter("date >= DATE '1997-01-15'"), month))).first()
    shares = {"close_q25": 0.25, "close_q50": 0.5, "close_q75": 0.75}
    near = [F.abs(F.count_if(F.col("close") <= F.lit(r[c])) / F.count(F.lit(1)) - q) <= sk.RANK_BOUND for c, q in shares.items()]
    symbols = F.count_distinct("symbol")
    checked = df.agg((F.abs(F.lit(r["total_stocks"]) - symbols) <= sk.SYMBOL_BOUND * symbols).alias("symbols_within_bound"),
                     (near[0] & near[1] & near[2]).alias("quantiles_within_bound"))
    return checked.select(*[F.lit(r[c]).alias(c) for c in ("total_records", "min_date", "max_date")], "symbols_within_bound", "quantiles_within_bound")


@register(
    "quality_report",
    statement(
        [BARS, f"r AS (SELECT symbol, date, volume, CASE WHEN volume % 11 > 0 THEN open END AS open, high, low, close, {pct('close')} AS ret FROM bars)"],
        "r", "symbol, count(*) AS total_rows, 6 AS total_columns, min(date) AS first_date, max(date) AS last_date, max(date) - min(date) AS duration_days",
        {"highest_close": "max(close)", "lowest_close": "min(close)", "average_close": "avg(close)", "latest_close": "arg_max(close, date)",
         "avg_return_pct": "avg(ret) * 100", "volatility_pct": "stddev_samp(ret) * 100", "max_gain_pct": "max(ret) * 100",
         "max_loss_pct": "min(ret) * 100", "missing_pct": "100.0 * count(*) FILTER (WHERE open IS NULL) / (count(*) * 6)"},
        tail="GROUP BY symbol"),
)
def _(spark, d):
    return sc.quality_report(bars(spark, d).withColumn("open", F.when(F.col("volume") % 11 > 0, F.col("open"))))


@register(
    "describe_close",
    statement(BARS, "bars", "symbol, count(close) AS count",
              {"mean": "avg(close)", "std": "stddev_samp(close)", "min": "min(close)", "q25": "quantile_cont(close, 0.25)",
               "q50": "quantile_cont(close, 0.5)", "q75": "quantile_cont(close, 0.75)", "max": "max(close)"}, tail="GROUP BY symbol"),
)
def _(spark, d):
    return sc.describe_close(bars(spark, d))


RET_PCT = f"r AS (SELECT symbol, date, {pct('close')} * 100 AS ret FROM bars)"


@register(
    "return_statistics",
    statement([BARS, RET_PCT], "r", "symbol",
              {"mean_return": "avg(ret)", "median_return": "quantile_cont(ret, 0.5)", "std_return": "stddev_samp(ret)",
               "skewness": "skewness(ret)", "kurtosis": "kurtosis(ret)", "best_day": "max(ret)", "worst_day": "min(ret)"}, tail="GROUP BY symbol"),
)
def _(spark, d):
    return sc.return_statistics(bars(spark, d))


@register(
    "return_histogram",
    statement(
        [BARS, RET_PCT, f"e AS (SELECT *, min(ret) OVER {SERIES} AS lo, max(ret) OVER {SERIES} AS hi FROM r WHERE ret IS NOT NULL)",
         "b AS (SELECT *, CAST(least(50, floor((ret - lo) * 50 / (hi - lo)) + 1) AS INTEGER) AS bin FROM e)"],
        "b", "symbol, bin, count(*) AS frequency", {"bin_start": "min(lo + (bin - 1) * (hi - lo) / 50)"}, tail="GROUP BY symbol, bin"),
)
def _(spark, d):
    return sc.return_histogram(bars(spark, d))


@register(
    "aligned_closes",
    statement(BARS, "bars", "date", {f'"{s}"': f"max(CASE WHEN symbol = {s} THEN close END)" for s in (1, 2, 3, 4, 5)},
              where="WHERE symbol IN (1, 2, 3, 4, 5)", tail="GROUP BY date"),
)
def _(spark, d):
    return sc.aligned_closes(bars(spark, d), [1, 2, 3, 4, 5])
