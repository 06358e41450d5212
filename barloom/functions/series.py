"""Window specifications and the column algebra every indicator is written in.

A *series* is one symbol in date order. The bar tables hold at most one row per
(symbol, date) (see ``operators.grain``), so a series can never be longer than
the number of calendar days it covers; that is the size bound behind every
``partitionBy("symbol")`` below.
"""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TEMP = "__"

_ORDER: ContextVar[tuple[str, ...]] = ContextVar("order", default=("date",))
_KEYS: ContextVar[tuple[str, ...]] = ContextVar("keys", default=("symbol",))


@contextmanager
def ordered_by(*columns: str):
    """Series built inside are ordered by these columns, which must give the order of the dates."""
    token = _ORDER.set(columns)
    try:
        yield
    finally:
        _ORDER.reset(token)


def series_order() -> tuple[str, ...]:
    return _ORDER.get()


@contextmanager
def partitioned_by(*columns: str):
    """Series built inside are partitioned by these columns: the symbol and functions of it."""
    token = _KEYS.set(columns)
    try:
        yield
    finally:
        _KEYS.reset(token)


def series_keys() -> tuple[str, ...]:
    return _KEYS.get()


def series(newest_first: bool = False):
    order = [F.col(c).desc() if newest_first else F.col(c).asc() for c in series_order()]
    return Window.partitionBy(*series_keys()).orderBy(*order)


def last_rows(n: int):
    return series().rowsBetween(-(n - 1), 0)


def so_far():
    return series().rowsBetween(Window.unboundedPreceding, 0)


def entire():
    """The whole series in date order, as one frame shared by all of its rows."""
    return series().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def whole_series():
    return Window.partitionBy(*series_keys())


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def full(n: int, aggregate: Column, of) -> Column:
    """Rolling aggregate that is null until the frame holds n non-null values."""
    frame = last_rows(n)
    return F.when(F.count(as_col(of)).over(frame) == n, aggregate.over(frame))


def mean(c, n: int) -> Column:
    return full(n, F.avg(as_col(c)), c)


def total(c, n: int) -> Column:
    return full(n, F.sum(as_col(c)), c)


def rolling_correlation(x, y, n: int) -> Column:
    frame = last_rows(n)
    x, y = as_col(x).cast("double"), as_col(y).cast("double")
    spread = F.stddev_pop(x).over(frame) * F.stddev_pop(y).over(frame)
    paired = F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).over(frame)
    return F.when(paired == n, F.try_divide(F.covar_pop(x, y).over(frame), spread))


def deviation(c, n: int) -> Column:
    return full(n, F.stddev_samp(as_col(c)), c)


BLOCK = 10


def long_totals(col: str, windows) -> tuple[dict[str, Column], dict[int, Column]]:
    """Rolling sums for several windows: a helper layer and ``{n: sum}`` built on it.

    Spark re-adds a sliding frame for every row, n additions each. A sum over a
    multiple of ten rows is instead put together from ten-row sums at lags
    0, 10, 20, …: a 200-row sum costs 10 additions and 19 lookups, and no
    subtraction means no cancellation.
    """
    base = f"__sum{BLOCK}_{col.strip('_')}"
    long = [n for n in windows if n > 2 * BLOCK and n % BLOCK == 0]
    helper = {base: total(col, BLOCK)} if long else {}
    sums = {}
    for n in windows:
        if n in long:
            blocks = [prev(base, k) if k else F.col(base) for k in range(0, n, BLOCK)]
            sums[n] = reduce(lambda a, b: a + b, blocks)
        else:
            sums[n] = total(col, n)
    return helper, sums


def highest(c, n: int) -> Column:
    return full(n, F.max(as_col(c)), c)


def lowest(c, n: int) -> Column:
    return full(n, F.min(as_col(c)), c)


def prev(c, k: int = 1) -> Column:
    return F.lag(as_col(c), k).over(series())


def nxt(c, k: int = 1) -> Column:
    return F.lead(as_col(c), k).over(series())


def ratio(a, b) -> Column:
    """Division that yields null for a zero divisor."""
    return F.try_divide(as_col(a), as_col(b))


def correlation(x, y) -> Column:
    """Pearson correlation aggregate; null when either side is constant.

    ``corr`` itself raises a division by zero there under ANSI rules.
    """
    x, y = as_col(x).cast("double"), as_col(y).cast("double")
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def pct_change(c, k: int = 1) -> Column:
    return ratio(c, prev(c, k)) - 1


def by_symbol(df: DataFrame) -> DataFrame:
    """The bars dealt by symbol over several tasks a core, for bundles whose work per byte is large.

    Left to itself, adaptive execution joins partitions of bare bars until there is about one a core,
    so the last task of many columns runs alone. Bars that are placed already stay where they are.
    """
    if series_keys() != ("symbol",):
        return df
    spark = df.sparkSession
    least = 4 * spark.sparkContext.defaultParallelism
    return df.repartition(max(least, int(spark.conf.get("spark.sql.shuffle.partitions"))), "symbol")


def strip_temps(df: DataFrame, keep=()) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(TEMP) and c not in keep])


def add_layers(df: DataFrame, *recipes: list[dict[str, Column]], late=False) -> DataFrame:
    """Add the columns of several recipes, one projection per dependency layer.

    A recipe is a list of ``{name: column}`` layers; a layer may refer to columns
    of earlier layers. Layers with the same index are added together, so the
    window expressions of all recipes end up in as few Window operators as the
    longest dependency chain needs, all over one exchange and one sort.

    ``late`` lets every recipe end with the longest one, for recipes that name all they need
    themselves: what a short one makes is not passed through the windows before. The order of
    the columns stays.
    """
    depth = max((len(r) for r in recipes), default=0)
    names = df.columns
    names += [name for i in range(depth) for r in recipes if i < len(r) for name in r[i]]
    if late:
        recipes = [[{}] * (depth - len(r)) + r for r in recipes]
    for level in range(depth):
        wanted: dict[str, Column] = {}
        for recipe in recipes:
            if level < len(recipe):
                for name, column in recipe[level].items():
                    if name not in df.columns:
                        wanted.setdefault(name, column)
        if wanted:
            df = df.withColumns(wanted)
    return df.select(*dict.fromkeys(names)) if late else df


def indicator(df: DataFrame, *recipes) -> DataFrame:
    """``add_layers`` without the helper columns."""
    return strip_temps(add_layers(df, *recipes), keep=df.columns)


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)
