"""Cleaning, filtering, sampling and splitting of bar tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.series import (
    all_of,
    as_col,
    entire,
    series,
    series_keys,
    series_order,
    so_far,
    strip_temps,
    whole_series,
)
from barloom.operators.grain import dedupe, latest_date
from barloom.schema import PRICE_COLUMNS

# Look-back periods and their length in days.
PERIOD_DAYS = {"1m": 30, "3m": 90, "6m": 180, "1y": 365, "2y": 730, "5y": 1825}


def forward_backward_fill(df: DataFrame, cols) -> DataFrame:
    """Last known value, else the next known one, in date order.

    What the forward fill leaves open lies before the first known value of the series,
    so the backward fill is that one value: a frame per series, not one per row.
    """
    known = {c: F.last(c, ignorenulls=True).over(so_far()) for c in cols}
    first = {c: F.first(c, ignorenulls=True).over(entire()) for c in cols}
    return df.withColumns({c: F.coalesce(known[c], first[c]) for c in cols})


def positive_prices(df: DataFrame) -> DataFrame:
    return df.filter(all_of([F.col(c) > 0 for c in PRICE_COLUMNS]))


def consistent_prices(df: DataFrame) -> DataFrame:
    """Rows whose high and low enclose the open and the close."""
    return df.filter(
        (F.col("high") >= F.greatest("low", "open", "close"))
        & (F.col("low") <= F.least("open", "close"))
    )


def drop_outliers(df: DataFrame, column="close", threshold=3.0) -> DataFrame:
    """Keep values within threshold·IQR of the exact quartiles of their symbol."""
    quartiles = F.percentile(column, F.array(F.lit(0.25), F.lit(0.75)))
    df_q = df.withColumn("__q", quartiles.over(whole_series()))
    q1, q3 = F.col("__q")[0], F.col("__q")[1]
    spread = threshold * (q3 - q1)
    return strip_temps(df_q.filter(F.col(column).between(q1 - spread, q3 + spread)), df.columns)


def clean_bars(df: DataFrame, iqr=3.0, column="close", seq=None) -> DataFrame:
    """Dedupe (keep first), fill, drop impossible and outlying rows."""
    if seq is not None:
        df = dedupe(df, seq=seq, keep="first")
    values = [c for c in df.columns if c not in ("symbol", "date", *series_keys(), *series_order())]
    df = forward_backward_fill(df, values)
    return drop_outliers(consistent_prices(positive_prices(df)), column, iqr)


def coerce_bars(raw: DataFrame, carry=()) -> DataFrame:
    """All-string bars to typed bars; rows with a cell that is unreadable or not finite are dropped."""
    def finite(c):
        value = F.col(c).try_cast("double")
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)

    typed = raw.select(
        "symbol",
        F.try_to_timestamp(F.col("date")).cast("date").alias("date"),
        *[finite(c).alias(c) for c in PRICE_COLUMNS],
        finite("volume").try_cast("long").alias("volume"),
        *carry,
    )
    return typed.dropna(subset=["date", *PRICE_COLUMNS, "volume"])


def within_period(df: DataFrame, period: str, as_of=None) -> DataFrame:
    """Rows of the last 30…1825 calendar days before ``as_of``; every row for 'all'."""
    if period == "all":
        return df
    anchor = latest_date(df) if as_of is None else as_of
    return df.filter(F.col("date") >= F.date_sub(anchor, PERIOD_DAYS[period]))


def between_dates(df: DataFrame, start=None, end=None) -> DataFrame:
    if start is not None:
        df = df.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col("date") <= F.lit(end).cast("date"))
    return df


def newest_rows(df: DataFrame, n: int) -> DataFrame:
    """The last n rows of every symbol (rows, not calendar days)."""
    rank = F.row_number().over(series(newest_first=True))
    return strip_temps(df.withColumn("__rn", rank).filter(F.col("__rn") <= n), df.columns)


def min_history(df: DataFrame, n: int = 200) -> DataFrame:
    """Rows of symbols that have at least n rows."""
    size = F.count(F.lit(1)).over(whole_series())
    return strip_temps(df.withColumn("__size", size).filter(F.col("__size") >= n), df.columns)


def sample_symbols(df: DataFrame, n: int, seed: int | None = 42) -> DataFrame:
    """All rows of n symbols: pseudo-random but reproducible, or the first n without a seed."""
    symbols = df.select("symbol").distinct()
    order = [F.xxhash64("symbol", F.lit(seed))] if seed is not None else []
    chosen = symbols.orderBy(*order, "symbol").limit(n)
    return df.join(chosen, "symbol", "left_semi")


def search_symbols(df: DataFrame, text: str | None) -> DataFrame:
    """Rows whose symbol contains the text, whatever its case; the text is a bound literal."""
    if not text:
        return df
    return df.filter(F.contains(F.lower(F.col("symbol").cast("string")), F.lit(text.lower())))


def feature_columns(df: DataFrame, exclude=()) -> list[str]:
    """Columns left after the raw bar columns, targets and further exclusions."""
    # Columns that never are features.
    raw = {"symbol", "date", "open", "high", "low", "close", "volume", "adj_close"}
    return [c for c in df.columns if c not in raw | set(exclude) and not c.startswith("target")]


def features_or_zero(df: DataFrame, features) -> DataFrame:
    """The features as doubles: those the table lacks, and missing or infinite values, are 0."""
    def filled(name):
        if name not in df.columns:
            return F.lit(0.0)
        value = F.col(name).cast("double")
        return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")), value).otherwise(0.0)

    return df.withColumns({f: filled(f) for f in features})


def ordered_split(df: DataFrame, train=0.8) -> DataFrame:
    """Adds ``part``: 'train' for the first ``int(n*train)`` rows of a symbol, else 'test'."""
    rn = F.row_number().over(series())
    n = F.count(F.lit(1)).over(whole_series())
    return df.withColumn(
        "part", F.when(rn <= F.floor(n * train), F.lit("train")).otherwise("test")
    )


def date_cutoff(df: DataFrame, train=0.8, date="date") -> Column:
    """Scalar subquery: the date by which the given share of all rows has passed."""
    per_day = df.groupBy(date).agg(F.count(F.lit(1)).alias("n"))
    day = F.unix_date(date).cast("double")
    return per_day.agg(F.date_from_unix_date(F.floor(F.percentile(day, F.lit(train), F.col("n"))).cast("int"))).scalar()


def rename_columns(df: DataFrame, mapping=None) -> DataFrame:
    """Lower-case canonical bar names; extra renames through ``mapping``."""
    names = {c: c.strip().lower().replace(" ", "_") for c in df.columns} | (mapping or {})
    return df.withColumnsRenamed(names)


def training_rows(df: DataFrame, columns) -> DataFrame:
    """Rows whose features and label are all finite and present.

    Only a finite number times 0 is 0. One sum of these is short enough to be compiled; with three
    conditions a column, the filter of some 40 columns became a method that the JVM only interprets.
    """
    zeros = [as_col(c).cast("double") * 0.0 for c in columns]
    return df.filter(sum(zeros[1:], zeros[0]) == 0.0)
