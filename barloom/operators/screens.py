"""Market screens, per-symbol summaries, paging and table statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import corrected_kurtosis, corrected_skewness, ladder
from barloom.functions.series import (
    all_of,
    add_layers,
    mean,
    pct_change,
    prev,
    ratio,
    series,
    strip_temps,
    whole_series,
)
from barloom.operators import indicators as ind
from barloom.operators.clean import newest_rows, search_symbols, within_period
from barloom.operators.grain import latest_date

# Closes kept by the screen, as name and bars back from the newest.
CLOSE_OFFSETS = {
    "day1_close": 1, "day2_close": 2, "day3_close": 3, "day4_close": 4, "day5_close": 5,
    "day6_close": 6, "day7_close": 7, "day14_close": 14, "day21_close": 21, "day31_close": 31,
}
# Percentage columns as (newer, older).
SCREEN_CHANGES = {
    "today_pct": ("today_close", "day1_close"),
    "yesterday_pct": ("day1_close", "day2_close"),
    "day2_pct": ("day2_close", "day3_close"),
    "day3_pct": ("day3_close", "day4_close"),
    "day4_pct": ("day4_close", "day5_close"),
    "day5_pct": ("day5_close", "day6_close"),
    "day6_pct": ("day6_close", "day7_close"),
    "week_7day_pct": ("today_close", "day7_close"),
    "week_7to14_pct": ("day7_close", "day14_close"),
    "week_14to21_pct": ("day14_close", "day21_close"),
    "week_21to31_pct": ("day21_close", "day31_close"),
}


def change_pct(newer, older) -> Column:
    newer, older = (F.col(c) if isinstance(c, str) else c for c in (newer, older))
    return ratio(newer - older, older) * 100


# --- ordering and paging --------------------------------------------------------

def ranked(df: DataFrame, sort_by="symbol", ascending=True, tie="symbol") -> DataFrame:
    """Total order by a column of the frame, nulls last, ties by symbol."""
    if sort_by not in df.columns:
        raise ValueError(f"cannot sort by {sort_by!r}")
    key = F.asc_nulls_last(sort_by) if ascending else F.desc_nulls_last(sort_by)
    return df.orderBy(key, *([tie] if tie != sort_by else []))


def page(df: DataFrame, number: int, size: int) -> DataFrame:
    """One page of an ordered frame; runs as a distributed top-k."""
    return df.offset((number - 1) * size).limit(size)


def page_info(df: DataFrame, size: int) -> DataFrame:
    rows = F.count(F.lit(1))
    return df.agg(rows.alias("total_rows"), F.ceil(rows / size).cast("long").alias("total_pages"))


# --- the market screen ------------------------------------------------------------

def recent_ranked(bars: DataFrame, lookback_days=60, newest_first="rn") -> DataFrame:
    """Bars within the last calendar days of each symbol, numbered from the newest."""
    last = F.max("date").over(whole_series())
    recent = bars.withColumn("__last", last).filter(
        F.col("date") >= F.date_sub("__last", lookback_days)
    )
    rank = F.row_number().over(series(newest_first=True))
    return strip_temps(recent.withColumn(newest_first, rank), bars.columns)


def year_stats(bars: DataFrame, as_of=None) -> DataFrame:
    """High, low and mean volume over the 365 calendar days before ``as_of``."""
    anchor = latest_date(bars) if as_of is None else as_of
    return (
        bars.filter(F.col("date") >= F.date_sub(anchor, 365))
        .groupBy("symbol")
        .agg(
            F.max("high").alias("week_52_high"),
            F.min("low").alias("week_52_low"),
            F.avg("volume").alias("avg_volume"),
        )
    )


def _pivot_columns() -> dict[str, Column]:
    def at(k, c):
        return F.max(F.when(F.col("rn") == k + 1, F.col(c)))

    today = {f"today_{c}": at(0, c) for c in ("date", "open", "close", "high", "low")}
    return today | {"volume": at(0, "volume")} | {n: at(k, "close") for n, k in CLOSE_OFFSETS.items()}


def recent_pivot(bars: DataFrame, lookback_days=60) -> DataFrame:
    """One row per symbol: today's bar and the closes of the fixed offsets.

    The rank limit comes first, so Spark applies it before the shuffle as well and each
    task sends at most 32 rows per symbol, however long the history. The day window
    only ever cuts the older end of those rows.
    """
    rank = F.row_number().over(series(newest_first=True))
    newest = bars.withColumn("rn", rank).filter(F.col("rn") <= 32)
    near = newest.withColumn("__last", F.max("date").over(whole_series())).filter(
        F.col("date") >= F.date_sub("__last", lookback_days)
    )
    return near.groupBy("symbol").agg(*[c.alias(n) for n, c in _pivot_columns().items()])


def screen_columns(wide: DataFrame) -> DataFrame:
    """Percentages, intraday move, volume ratio and 52-week position of a pivoted screen."""
    pct = {
        name: F.coalesce(F.round(change_pct(a, b), 2), F.lit(0.0))
        for name, (a, b) in SCREEN_CHANGES.items()
    }
    position = ratio(
        F.col("today_close") - F.col("week_52_low"), F.col("week_52_high") - F.col("week_52_low")
    )
    return wide.withColumns(
        {"today_change": F.col("today_close") - F.col("day1_close")}
        | pct
        | {
            "intraday_change": F.round(change_pct("today_close", "today_open"), 2),
            "volume_ratio": F.round(ratio("volume", "avg_volume"), 2),
            "week_52_position": F.round(position * 100, 1),
        }
    )


def market_screen(
    bars: DataFrame, as_of=None, lookback_days=60, search=None,
    sort_by=None, ascending=True, page_number=None, per_page=None,
) -> DataFrame:
    """Latest prices of every symbol with period changes and 52-week statistics.

    Neither half shuffles the history: the pivot sends its newest 32 rows per symbol and
    task, the 52-week statistics scan one year and send one partial row. Both halves
    arrive partitioned by symbol, so their join adds no shuffle. The day window is
    anchored at each symbol's own last bar, the 52 weeks at ``as_of``.
    """
    bars = search_symbols(bars, search)
    wide = recent_pivot(bars, lookback_days).join(year_stats(bars, as_of), "symbol", "left")
    out = screen_columns(wide)
    if sort_by is not None or page_number is not None:
        out = ranked(out, sort_by or "symbol", ascending)
    if page_number is not None:
        out = page(out, page_number, per_page or 50)
    return out


def screen_with_forecasts(screen: DataFrame, latest_forecasts: DataFrame) -> DataFrame:
    """Left join of a screen to the newest forecast of each symbol."""
    cols = ["predicted_price", "predicted_change_pct", "confidence", "model_used"]
    return screen.join(latest_forecasts.select("symbol", *cols), "symbol", "left")


# --- other screens -----------------------------------------------------------------

def last_bar_summary(bars: DataFrame, rows_52w=252) -> DataFrame:
    """Per symbol at its newest bar: prices, changes over 1, 5, 21 bars, 252-row range."""
    rank = F.row_number().over(series(newest_first=True))
    placed = bars.withColumn("__rn", rank).filter(F.col("__rn") <= max(rows_52w, 22))
    in_year = F.col("__rn") <= rows_52w

    def at(k, c="close"):
        return F.max(F.when(F.col("__rn") == k + 1, F.col(c)))

    wide = placed.groupBy("symbol").agg(
        at(0).alias("price"), at(0, "volume").alias("volume"),
        at(1).alias("__c1"), at(2).alias("__c2"), at(5).alias("__c5"), at(21).alias("__c21"),
        F.max(F.when(in_year, F.col("high"))).alias("high_52w"),
        F.min(F.when(in_year, F.col("low"))).alias("low_52w"),
    )
    changes = {
        f"returns_{name}": F.coalesce(change_pct("price", c), F.lit(0.0))
        for name, c in {"1d": "__c1", "5d": "__c5", "1m": "__c21"}.items()
    }
    changes["yesterday_change"] = F.coalesce(change_pct("__c1", "__c2"), F.lit(0.0))
    changes["distance_from_high"] = change_pct("price", "high_52w")
    return strip_temps(wide.withColumns(changes))


# Criteria as (column, comparison).
CRITERIA = {
    "price_min": ("price", ">="), "price_max": ("price", "<="), "volume_min": ("volume", ">="),
    "returns_1d_min": ("returns_1d", ">="), "returns_1m_min": ("returns_1m", ">="),
}


def filter_symbols(bars: DataFrame, criteria: dict, sort_by="returns_1d", ascending=False, limit=50):
    """Symbols meeting every given criterion, best first."""
    unknown = set(criteria) - set(CRITERIA)
    if unknown:
        raise ValueError(f"unknown criteria {sorted(unknown)}")
    out = last_bar_summary(bars).drop("distance_from_high", "yesterday_change")
    tests = []
    for name, bound in criteria.items():
        column, op = CRITERIA[name]
        c = F.col(column)
        tests.append(c >= bound if op == ">=" else c <= bound)
    if tests:
        out = out.filter(all_of(tests))
    out = ranked(out, sort_by, ascending)
    return out if limit is None else out.limit(limit)


def near_high(bars: DataFrame, within_pct=5.0) -> DataFrame:
    out = last_bar_summary(bars).select("symbol", "price", "high_52w", "low_52w", "distance_from_high")
    return out.filter(F.col("distance_from_high") > -within_pct)


def yesterday_change(bars: DataFrame) -> DataFrame:
    return last_bar_summary(bars).select("symbol", "yesterday_change")


def trend_states(bars: DataFrame) -> DataFrame:
    """RSI zone and moving-average trend of every symbol at its newest bar."""
    df = add_layers(newest_rows(bars, 64), ind.rsi_recipe((14,)), ind.sma_recipe((20, 50)))
    latest = df.withColumn("__rn", F.row_number().over(series(newest_first=True))).filter("__rn = 1")
    rsi = F.col("rsi_14")
    up = (F.col("close") > F.col("sma_20")) & (F.col("sma_20") > F.col("sma_50"))
    down = (F.col("close") < F.col("sma_20")) & (F.col("sma_20") < F.col("sma_50"))
    return latest.select(
        "symbol", "date", "close", "rsi_14", "sma_20", "sma_50",
        ladder([(rsi > 70, "overbought"), (rsi < 30, "oversold")], "neutral").alias("rsi_zone"),
        ladder([(up, "bullish"), (down, "bearish")], "none").alias("trend"),
    )


def detail_series(bars: DataFrame, period="1y", as_of=None) -> DataFrame:
    """The charted series: period rows with returns in percent and two averages."""
    rows = within_period(bars, period, as_of)
    return rows.withColumns(
        {"returns_pct": pct_change("close") * 100, "ma_20": mean("close", 20), "ma_50": mean("close", 50)}
    )


# --- statistics ---------------------------------------------------------------------

def summary_card(bars: DataFrame) -> DataFrame:
    """Last price, change, 252-row range, volatility and volume of every symbol."""
    rank = F.row_number().over(series(newest_first=True))
    placed = bars.withColumns({"__rn": rank, "__prev": prev("close"), "__ret": pct_change("close")})
    first = F.col("__rn") == 1

    def newest(c):
        return F.max(F.when(first, F.col(c)))

    in_year = F.col("__rn") <= 252
    out = placed.groupBy("symbol").agg(
        newest("close").alias("latest_price"), newest("open").alias("open_price"),
        newest("high").alias("high_price"), newest("low").alias("low_price"),
        F.coalesce(newest("__prev"), newest("close")).alias("__before"),
        F.max(F.when(in_year, F.col("high"))).alias("high_52w"),
        F.min(F.when(in_year, F.col("low"))).alias("low_52w"),
        F.stddev_samp("__ret").alias("daily_volatility"),
        F.avg("volume").alias("avg_volume"), newest("volume").alias("latest_volume"),
    )
    return strip_temps(
        out.withColumns(
            {
                "change": F.col("latest_price") - F.col("__before"),
                "change_pct": F.coalesce(change_pct("latest_price", "__before"), F.lit(0.0)),
                "annual_volatility": F.col("daily_volatility") * math.sqrt(252),
            }
        )
    )


def table_stats(bars: DataFrame, approximate=False) -> DataFrame:
    """Rows, symbols and date span; symbols are counted after a per-symbol pre-aggregation."""
    if approximate:
        return bars.agg(
            F.count(F.lit(1)).alias("total_records"), F.approx_count_distinct("symbol").alias("total_stocks"),
            F.min("date").alias("min_date"), F.max("date").alias("max_date"),
        )
    per_symbol = bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi")
    )
    return per_symbol.agg(
        F.sum("n").alias("total_records"), F.count(F.lit(1)).alias("total_stocks"),
        F.min("lo").alias("min_date"), F.max("hi").alias("max_date"),
    )


def quality_report(df: DataFrame) -> DataFrame:
    """Per symbol: size, span, close and return statistics, share of missing cells."""
    cols = [c for c in df.columns if c != "symbol"]
    missing = sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0))
    placed = df.withColumns({"__ret": pct_change("close"), "__missing": missing})
    return placed.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.lit(len(cols)).alias("total_columns"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.datediff(F.max("date"), F.min("date")).alias("duration_days"),
        F.max("close").alias("highest_close"), F.min("close").alias("lowest_close"),
        F.avg("close").alias("average_close"), F.max_by("close", "date").alias("latest_close"),
        (F.avg("__ret") * 100).alias("avg_return_pct"),
        (F.stddev_samp("__ret") * 100).alias("volatility_pct"),
        (F.max("__ret") * 100).alias("max_gain_pct"), (F.min("__ret") * 100).alias("max_loss_pct"),
        (F.sum("__missing") * 100.0 / (F.count(F.lit(1)) * len(cols))).alias("missing_pct"),
    )


def describe_close(bars: DataFrame) -> DataFrame:
    q = F.percentile("close", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return (
        bars.groupBy("symbol")
        .agg(
            F.count("close").alias("count"), F.avg("close").alias("mean"),
            F.stddev_samp("close").alias("std"), F.min("close").alias("min"),
            q.alias("__q"), F.max("close").alias("max"),
        )
        .withColumns({"q25": F.col("__q")[0], "q50": F.col("__q")[1], "q75": F.col("__q")[2]})
        .drop("__q")
    )


def return_statistics(bars: DataFrame) -> DataFrame:
    """Mean, median, deviation, corrected skewness and kurtosis, best and worst day in percent."""
    placed = bars.withColumn("__ret", pct_change("close") * 100)
    n = F.count("__ret")
    return placed.groupBy("symbol").agg(
        F.avg("__ret").alias("mean_return"), F.median("__ret").alias("median_return"),
        F.stddev_samp("__ret").alias("std_return"),
        corrected_skewness(F.skewness("__ret"), n).alias("skewness"),
        corrected_kurtosis(F.kurtosis("__ret"), n).alias("kurtosis"),
        F.max("__ret").alias("best_day"), F.min("__ret").alias("worst_day"),
    )


def return_histogram(bars: DataFrame, bins=50) -> DataFrame:
    """Equal-width bins of each symbol's daily returns in percent."""
    rets = bars.withColumn("ret", pct_change("close") * 100).filter(F.col("ret").isNotNull())
    lo, hi = F.min("ret").over(whole_series()), F.max("ret").over(whole_series())
    placed = rets.withColumns({"lo": lo, "hi": hi})
    slot = F.floor(ratio((F.col("ret") - F.col("lo")) * bins, F.col("hi") - F.col("lo"))) + 1
    binned = placed.withColumn("bin", F.coalesce(F.least(slot, F.lit(bins)), F.lit(1)).cast("int"))
    return binned.groupBy("symbol", "bin").agg(
        F.count(F.lit(1)).alias("frequency"),
        F.min(F.col("lo") + (F.col("bin") - 1) * (F.col("hi") - F.col("lo")) / bins).alias("bin_start"),
    )


# --- symbols ------------------------------------------------------------------------

def symbol_list(bars: DataFrame) -> DataFrame:
    return bars.select("symbol").distinct()


def one_symbol(bars: DataFrame, symbol, limit=None) -> DataFrame:
    """Bars of one symbol, oldest first."""
    out = bars.filter(F.col("symbol") == F.lit(symbol)).orderBy("date")
    return out if limit is None else out.limit(limit)


def symbol_metadata(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("record_count"),
        F.max("date").alias("last_date"),
        F.max_by("close", "date").alias("last_close"),
    )


def uncovered(symbols: DataFrame, covered: DataFrame) -> DataFrame:
    """Symbols with no row in ``covered``: what still needs work."""
    return symbols.join(covered.select("symbol").distinct(), "symbol", "left_anti")


def aligned_closes(bars: DataFrame, symbols: list) -> DataFrame:
    """Wide table date × symbol of the closes of a given symbol list."""
    chosen = bars.filter(F.col("symbol").isin(*symbols))
    return chosen.groupBy("date").pivot("symbol", list(symbols)).agg(F.first("close"))
