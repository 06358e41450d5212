"""Exponential moving averages as a segmented affine scan over calendar blocks.

The recurrence is an affine map per row. A row with a value maps the average y before it to
``(w*y + a*x) / (w + a)`` with ``w = (1-a)**steps``, ``steps`` the rows since the last value: 1
without gaps, where ``w + a`` is 1. A row without a value is the identity: it repeats the average
before it, and rows before the first value have none.

Inside a block of rows the composed maps are a running sum of ``x`` weighted by powers of ``1-a``
and, after gaps, by the products of ``w + a``. A block is a span of calendar days, so it holds at
most that many rows and the powers stay inside the double range. What earlier blocks contribute
is one map per block, folded from the short list of earlier block tails. Every step is a window
over the same (symbol, block, date) order: one exchange, one sort, no join and no Python.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.series import as_col, ordered_by, ratio, series_keys, series_order, strip_temps

# (1-a)**-BLOCK_DAYS must stay finite: 3**512 for span 2 is about 1e244.
BLOCK_DAYS = 512
BLOCK = "__block"


def _series():
    return Window.partitionBy(*series_keys()).orderBy(BLOCK, "date")


def _block():
    return Window.partitionBy(*series_keys(), BLOCK).orderBy("date")


def _blocks(df: DataFrame) -> DataFrame:
    return df.withColumn(BLOCK, F.floor(F.unix_date("date") / BLOCK_DAYS).cast("int"))


def blockwise(bundle):
    """A bundle whose other windows are ordered by (block, date) as well, which is the order of the dates.

    One sort of the bare bars then serves all windows; with two orders the second sort
    would move, and spill, every column made before it. Inside another such bundle its order is kept.
    """
    @wraps(bundle)
    def run(df: DataFrame, *args, **options) -> DataFrame:
        if BLOCK in series_order():
            return bundle(df, *args, **options)
        with ordered_by(BLOCK, "date"):
            return bundle(_blocks(df), *args, **options).drop(BLOCK)

    return run


def _mark(df: DataFrame) -> DataFrame:
    if BLOCK not in series_order():
        df = _blocks(df)
    df = df.withColumn("__row", F.row_number().over(_series()))
    return df.withColumns(
        {
            "__pos": (F.row_number().over(_block()) - 1).cast("double"),
            "__ends_block": F.lead("date").over(_block()).isNull(),
        }
    )


def _average(df: DataFrame, targets: dict[str, tuple[object, int]]) -> DataFrame:
    """Add ``{name: (column, span)}`` averages to a marked frame."""
    keep = df.columns
    so_far = _series().rowsBetween(Window.unboundedPreceding, 0)
    plain = {name: F.last(as_col(c), ignorenulls=True).over(so_far) for name, (c, span) in targets.items() if span == 1}
    spans = {name: span for name, (_, span) in targets.items() if span > 1}
    names = list(spans)
    if not names:
        return df.withColumns(plain)

    # Averages of one column share what depends on its gaps alone.
    columns, of = {}, {}
    for name in names:
        c = targets[name][0]
        of[name] = c if isinstance(c, str) else name
        columns.setdefault(of[name], as_col(c))
    growing = _block().rowsBetween(Window.unboundedPreceding, 0)
    earlier = _series().rowsBetween(Window.unboundedPreceding, -1)
    valid = {k: c.isNotNull() for k, c in columns.items()}
    df = df.withColumns(
        {f"__last_{k}": F.max(F.when(valid[k], F.col("__row"))).over(earlier) for k in columns}
    )
    steps = {k: (F.col("__row") - F.col(f"__last_{k}")).cast("double") for k in columns}

    def decay(name):
        return 1.0 - 2.0 / (spans[name] + 1)

    def norm(name):
        """w + a of a row with a value; exactly 1 without a gap."""
        gap = F.pow(F.lit(decay(name)), steps[of[name]]) + (1.0 - decay(name))
        return F.when(steps[of[name]] > 1, gap).otherwise(1.0)

    # Exponents: the place of the last value in the block, and what the block's first value adds to it.
    exponents = {}
    for k in columns:
        at = F.when(valid[k], F.col("__pos"))
        exponents[f"__at_{k}"] = F.last(at, ignorenulls=True).over(growing)
        exponents[f"__lead_{k}"] = F.first(F.when(valid[k], F.coalesce(steps[k], F.lit(0.0)) - F.col("__pos")), ignorenulls=True).over(growing)
    gaps = {
        f"__gap_{n}": F.sum(F.when(valid[of[n]], -F.ln(norm(n))).otherwise(0.0)).over(growing) for n in names
    }
    df = df.withColumns(exponents | gaps)

    local = {}
    for name in names:
        k, q = of[name], F.lit(decay(name))
        weight = F.when(F.col(f"__last_{k}").isNull(), 1.0).otherwise((1.0 - decay(name)) / norm(name))
        term = columns[k] * weight * F.pow(q, -F.col("__pos")) * F.exp(-F.col(f"__gap_{name}"))
        total = F.sum(term).over(growing)
        local[f"__local_{name}"] = F.pow(q, F.col(f"__at_{k}")) * F.exp(F.col(f"__gap_{name}")) * total
    df = df.withColumns(local)

    def through(name):
        """The weight that the average before the block still has."""
        k = of[name]
        return F.pow(F.lit(decay(name)), F.col(f"__at_{k}") + F.col(f"__lead_{k}")) * F.exp(F.col(f"__gap_{name}"))

    def tail(name):
        end = F.struct(through(name).alias("weight"), F.col(f"__local_{name}").alias("value"))
        return F.collect_list(F.when(F.col("__ends_block") & F.col(f"__at_{of[name]}").isNotNull(), end)).over(earlier)

    df = df.withColumns({f"__tails_{n}": tail(n) for n in names})

    def carry_in(name):
        tails = F.col(f"__tails_{name}")
        folded = F.aggregate(tails, F.lit(0.0), lambda acc, t: acc * t["weight"] + t["value"])
        return F.when((F.col("__pos") == 0) & (F.size(tails) > 0), folded)

    df = df.withColumns({f"__enter_{n}": carry_in(n) for n in names})
    df = df.withColumns({f"__carry_{n}": F.first(f"__enter_{n}").over(growing) for n in names})
    done = {
        n: F.when(F.col(f"__at_{of[n]}").isNull(), F.col(f"__carry_{n}")).otherwise(
            F.col(f"__local_{n}") + F.coalesce(through(n) * F.col(f"__carry_{n}"), F.lit(0.0)))
        for n in names
    }
    return df.withColumns(done | plain).select(*keep, *targets)


def ewm(df: DataFrame, *passes: dict[str, tuple[object, int]]) -> DataFrame:
    """Exponential averages, ``{name: (column, span)}``; a null repeats the average before it.

    Later passes may average columns made from the results of earlier ones, as
    the MACD signal line does; all passes share one exchange and one sort.
    """
    keep = df.columns
    df = _mark(df)
    for targets in passes:
        df = _average(df, targets)
    return strip_temps(df, keep=keep)


def ema(df: DataFrame, spans=(12, 26), col="close") -> DataFrame:
    return ewm(df, {f"ema_{span}": (col, span) for span in spans})


def macd(df: DataFrame, fast=12, slow=26, signal=9, scale=None) -> DataFrame:
    """MACD line, signal line and histogram; ``scale`` divides the line before the signal."""
    return macd_set(df, [(fast, slow, signal)], scale=scale, named=False)


def macd_set(df: DataFrame, settings, scale=None, named=True, also=None, changes=None) -> DataFrame:
    """Several MACD settings (and extra averages ``also``) in two shared passes.

    ``changes`` adds relative changes ``{name: (column, rows)}`` of the new columns over
    the order the passes have already sorted by.
    """
    keep = df.columns
    spans = sorted({s for fast, slow, _ in settings for s in (fast, slow)})
    first = {f"__ema_{s}": ("close", s) for s in spans} | (also or {})
    lines, signals, hist = {}, {}, {}
    for fast, slow, signal in settings:
        tag = f"_{fast}_{slow}" if named else ""
        line = F.col(f"__ema_{fast}") - F.col(f"__ema_{slow}")
        lines[f"macd{tag}"] = line if scale is None else line / scale
        full_tag = f"{tag}_{signal}" if named else ""
        signals[f"macd_signal{full_tag}"] = (f"macd{tag}", signal)
        hist[f"macd_hist{full_tag}"] = F.col(f"macd{tag}") - F.col(f"macd_signal{full_tag}")
    df = _average(_mark(df), first).withColumns(lines)
    df = _average(df, signals).withColumns(hist)
    moved = {
        name: ratio(c, F.lag(c, k).over(_series())) - 1 for name, (c, k) in (changes or {}).items()
    }
    return strip_temps(df.withColumns(moved) if moved else df, keep=keep)
