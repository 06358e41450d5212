"""Row-level functions: calendar parts, safe numbers, labels, moment corrections."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.series import as_col, ratio


# --- calendar ---------------------------------------------------------------

def date_parts(date="date") -> dict[str, Column]:
    d = as_col(date)
    return {
        "year": F.year(d),
        "month": F.month(d),
        "day": F.dayofmonth(d),
        "day_of_week": F.weekday(d),
        "quarter": F.quarter(d),
        "day_of_year": F.dayofyear(d),
        "week_of_year": F.weekofyear(d),
    }


def calendar_flags(date="date") -> dict[str, Column]:
    d = as_col(date)
    starts_month = F.dayofmonth(d) == 1
    ends_month = d == F.last_day(d)
    return {
        "is_month_start": starts_month.cast("int"),
        "is_month_end": ends_month.cast("int"),
        "is_quarter_start": (starts_month & (F.month(d) % 3 == 1)).cast("int"),
        "is_quarter_end": (ends_month & (F.month(d) % 3 == 0)).cast("int"),
    }


def cyclical(part: Column, period: int) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * part / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def calendar_features(df: DataFrame, date="date") -> DataFrame:
    d = as_col(date)
    day_sin, day_cos = cyclical(F.weekday(d), 7)
    month_sin, month_cos = cyclical(F.month(d), 12)
    return df.withColumns(
        date_parts(d)
        | {"day_sin": day_sin, "day_cos": day_cos, "month_sin": month_sin, "month_cos": month_cos}
        | calendar_flags(d)
    )


# --- numbers ----------------------------------------------------------------

def finite(c) -> Column:
    """Null for NaN and ±infinity, the value otherwise."""
    c = as_col(c)
    unusable = F.isnan(c) | c.isin(float("inf"), float("-inf"))
    return F.when(~unusable, c)


def finite_or(c, default) -> Column:
    return F.coalesce(finite(c), F.lit(default))


def finite_columns(df: DataFrame, columns) -> DataFrame:
    return df.withColumns({c: finite(c) for c in columns})


def clip(c, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(as_col(c), F.lit(high)))


# --- bias-corrected moments ---------------------------------------------------

def corrected_skewness(population: Column, n: Column) -> Column:
    n = n.cast("double")
    return F.when(n > 2, population * ratio(F.sqrt(n * (n - 1)), n - 2))


def corrected_kurtosis(population: Column, n: Column) -> Column:
    n = n.cast("double")
    scale = ratio(n - 1, (n - 2) * (n - 3))
    return F.when(n > 3, scale * ((n + 1) * population + 6))


# --- labels -------------------------------------------------------------------

def ladder(rungs: list[tuple[Column, str]], otherwise: str) -> Column:
    """First matching condition decides the label."""
    (first, label), *rest = rungs
    out = F.when(first, label)
    for condition, text in rest:
        out = out.when(condition, text)
    return out.otherwise(otherwise)


def symbol_from_path(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.csv(?:\.gz)?$", 1)
