"""Query registry, table access and the SQL fragments the statements share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import forecast as fc
from barloom.operators import validation as val
from barloom.sources.derive import bars_from_events, derive_bars

QUERIES: dict = {}
UNROUNDED: dict = {}
ORACLES: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark, sf_dir):
    return derive_bars(table(spark, sf_dir, "lineitem"))


def tame(spark, sf_dir):
    return derive_bars(table(spark, sf_dir, "lineitem"), tame=True)


def daily_events(spark, sf_dir):
    return bars_from_events(table(spark, sf_dir, "events"))


def as_of(spark, sf_dir):
    """Newest date of the bars, read from the raw table so that nothing is grouped for it."""
    return table(spark, sf_dir, "lineitem").agg(F.max(F.to_date("l_shipdate"))).scalar()


def forecasts(spark, sf_dir):
    """Trend forecasts made at every bar, attributed to three models by symbol."""
    rows = fc.trend_forecast_history(tame(spark, sf_dir))
    return rows.withColumn("model_used", F.concat(F.lit("model_"), F.col("symbol") % 3))


def scored(spark, sf_dir, match="next_bar"):
    prices = tame(spark, sf_dir)
    made = fc.trend_forecast_history(prices)
    made = made.withColumn("model_used", F.concat(F.lit("model_"), F.col("symbol") % 3))
    return val.score_forecasts(made, prices, match)


# Doubles are compared after rounding to 4 places from 100 upwards and to ``digits``
# below. The offset moves the rounding boundary off the decimal ties that prices such
# as 2058.8259375 sit on and that the two engines resolve differently.
LARGE, LARGE_DIGITS = 100, 4


def _offset(digits):
    return 1.37 * 10.0 ** -(digits + 2)


def half_up(c, digits):
    """Exactly ``F.round`` of a double below 1e6, without its way through decimal text where no tie is near.

    There the scaled double is off by less than 1e-5, so its nearest integer is the one that F.round
    finds, and dividing that by the scale gives the double nearest to the decimal.
    """
    scaled = c * F.lit(10.0**digits)
    nearest = F.rint(scaled)
    clear = (F.abs(scaled) < 1e10) & (F.abs(F.abs(scaled - nearest) - 0.5) > 1e-4)
    return F.when(clear, nearest / F.lit(10.0**digits)).otherwise(F.round(c, digits))


def rounded(df: DataFrame, digits=6) -> DataFrame:
    def tidy(name):
        c = F.col(name)
        large = half_up(c + F.lit(_offset(LARGE_DIGITS)), LARGE_DIGITS)
        small = half_up(c + F.lit(_offset(digits)), digits)
        return (F.when(F.abs(c) >= LARGE, large).otherwise(small) + F.lit(0.0)).alias(name)

    doubles = {c for c, t in df.dtypes if t in ("double", "float")}
    return df.select(*[tidy(c) if c in doubles else F.col(f"`{c}`") for c in df.columns])


def tidy_sql(expr, digits=6):
    x = f"CAST({expr} AS DOUBLE)"
    return (f"CASE WHEN abs({x}) >= {LARGE} THEN round({x} + {_offset(LARGE_DIGITS)!r}::DOUBLE, {LARGE_DIGITS}) "
            f"ELSE round({x} + {_offset(digits)!r}::DOUBLE, {digits}) END + 0.0")


def register(name, sql=None, digits=6):
    """Register a query; its doubles are rounded, as they are in its SQL statement."""

    def add(fn):
        UNROUNDED[name] = fn
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir), digits)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# --- SQL fragments ------------------------------------------------------------

def _bars_cte(name, price):
    key = "(l_orderkey, l_linenumber, l_partkey, l_extendedprice)"
    return f"""{name} AS (
  SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date,
         arg_min({price}, {key}) AS open, max({price}) AS high, min({price}) AS low,
         arg_max({price}, {key}) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume
  FROM lineitem GROUP BY ALL)"""


BARS = _bars_cte("bars", "l_extendedprice / l_quantity")
TAME = _bars_cte("bars", "100 * (1 + l_discount) + l_quantity / 50")
EVENT_BARS = """bars AS (
  SELECT event_type AS symbol, CAST(ts AS DATE) AS date,
         arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, (ts, event_id)) AS close, count(*) AS volume
  FROM events GROUP BY ALL)"""
BAR_COLS = "symbol, date, open, high, low, close, volume"

W = "(PARTITION BY symbol ORDER BY date)"
DESC = "(PARTITION BY symbol ORDER BY date DESC)"
SO_FAR = "(PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
SERIES = "(PARTITION BY symbol)"


def frame(n):
    return f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(n, agg, x):
    return f"CASE WHEN count({x}) OVER {frame(n)} = {n} THEN {agg} OVER {frame(n)} END"


def mean(x, n):
    return full(n, f"avg({x})", x)


def std(x, n):
    return full(n, f"stddev_samp({x})", x)


def top(x, n):
    return full(n, f"max({x})", x)


def low(x, n):
    return full(n, f"min({x})", x)


def total(x, n):
    return full(n, f"sum({x})", x)


def lag(x, k=1):
    return f"lag({x}, {k}) OVER {W}"


def lead(x, k=1):
    return f"lead({x}, {k}) OVER {W}"


def div(a, b):
    return f"(({a}) / nullif({b}, 0))"


def pct(x, k=1):
    return f"({div(x, lag(x, k))} - 1)"


def statement(ctes, source, plain, numbers=(), digits=6, where="", tail=""):
    """``WITH ctes SELECT plain…, round(number)… FROM source``.

    ``numbers`` maps output names to expressions; a list takes columns as they are.
    """
    if not isinstance(numbers, dict):
        numbers = {n: n for n in numbers}
    cols = ([plain] if plain else []) + [
        f"{tidy_sql(e, digits)} AS {n}" for n, e in numbers.items()
    ]
    ctes = ctes if isinstance(ctes, str) else ",\n".join(ctes)
    return f"WITH RECURSIVE {ctes}\nSELECT {', '.join(cols)}\nFROM {source} {where} {tail}"


def layers(base, *steps):
    """CTEs l1, l2, …: each adds the given expressions to everything before it."""
    out, prev = [], base
    for i, step in enumerate(steps, 1):
        exprs = ", ".join(f"{e} AS {n}" for n, e in step.items())
        out.append(f"l{i} AS (SELECT *, {exprs} FROM {prev})")
        prev = f"l{i}"
    return out, prev


FORECAST_CTE = f"""m1 AS (
  SELECT *, avg(close) OVER {frame(20)} AS ma20,
         CASE WHEN count(close) OVER {frame(50)} = 50 THEN avg(close) OVER {frame(50)}
              ELSE avg(close) OVER {frame(20)} END AS ma50,
         coalesce(stddev_samp(close) OVER {frame(20)}, 0) AS vol
  FROM bars),
m2 AS (
  SELECT *, ((close - ma20) / ma20 * 100 * 0.6
             + CASE WHEN ma50 > 0 THEN (ma20 - ma50) / ma50 * 100 ELSE 0 END * 0.4) * 0.3 AS chg
  FROM m1),
forecasts AS (
  SELECT symbol, date AS made_on, date + 1 AS prediction_date, close AS current_price,
         close * (1 + chg / 100) AS predicted_price, chg AS predicted_change_pct,
         greatest(40, least(90, 70 - vol / close * 100)) AS confidence,
         'model_' || (symbol % 3) AS model_used
  FROM m2)"""

SCORE_SELECT = """
  SELECT *, abs(predicted_price - actual_price) AS price_error,
         abs(predicted_price - actual_price) / actual_price * 100 AS price_error_pct,
         (actual_price - current_price) / current_price * 100 AS actual_change_pct
  FROM matched"""
SCORED_CTE = f"""scored0 AS ({SCORE_SELECT}),
scored AS (
  SELECT *, (predicted_change_pct > 0) = (actual_change_pct > 0) AS direction_correct,
         greatest(0, 100 - price_error_pct) AS accuracy_score, 100 - price_error_pct AS accuracy,
         CASE WHEN price_error_pct < 5 THEN 'accurate'
              WHEN price_error_pct < 10 THEN 'moderate' ELSE 'poor' END AS status
  FROM scored0)"""
NEXT_BAR_CTE = f"""following AS (
  SELECT symbol, date AS made_on, lead(date) OVER {W} AS validation_date,
         lead(close) OVER {W} AS actual_price FROM bars),
matched AS (
  SELECT f.*, n.validation_date, n.actual_price
  FROM forecasts f JOIN following n ON f.symbol = n.symbol AND f.made_on = n.made_on
  WHERE n.validation_date IS NOT NULL)"""
VALIDATION_CTES = f"{TAME},\n{FORECAST_CTE},\n{NEXT_BAR_CTE},\n{SCORED_CTE}"


def ema_cte(out, source, x, span):
    """Recursive CTE of an exponential average over ``source(symbol, date, rn, x)``."""
    a = f"(2.0 / {span + 1})"
    return f"""{out} AS (
  SELECT symbol, rn, CAST({x} AS DOUBLE) AS y FROM {source} WHERE rn = 1
  UNION ALL
  SELECT s.symbol, s.rn, {a} * s.{x} + (1 - {a}) * r.y
  FROM {out} r JOIN {source} s ON s.symbol = r.symbol AND s.rn = r.rn + 1)"""


def gapped_ema_cte(out, source, x, span):
    """The same over a column with nulls: a null keeps the average and lets its weight decay."""
    a = f"(2.0 / {span + 1})"
    return f"""{out} AS (
  SELECT symbol, rn, CAST({x} AS DOUBLE) AS y, CAST(1 AS DOUBLE) AS w FROM {source} WHERE rn = 1
  UNION ALL
  SELECT s.symbol, s.rn,
         CASE WHEN s.{x} IS NULL THEN r.y WHEN r.y IS NULL THEN s.{x}
              ELSE ((1 - {a}) * r.w * r.y + {a} * s.{x}) / ((1 - {a}) * r.w + {a}) END,
         CASE WHEN s.{x} IS NULL THEN r.w * (1 - {a}) ELSE 1 END
  FROM {out} r JOIN {source} s ON s.symbol = r.symbol AND s.rn = r.rn + 1)"""


NUMBERED = f"numbered AS (SELECT *, row_number() OVER {W} AS rn FROM bars)"
