"""Bars, cleaning, filtering, joins to keys, upkeep."""

from pyspark.sql import functions as F

from barloom.operators import clean, upkeep
from barloom.operators import screens as sc
from barloom.operators.grain import dedupe
from barloom.functions import scalars
from barloom.functions.series import add_layers, nxt
from barloom.operators import indicators as ind
from barloom.shared import fresh_path
from barloom.sources.derive import trades
from catalog.registry import (
    BARS, BAR_COLS, DESC, EVENT_BARS, SERIES, SO_FAR, TAME, W, as_of, bars, daily_events, full, lag,
    lead, register, statement, table, tame,
)

PRICES = ["open", "high", "low", "close"]
NEWEST = "(SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem)"


@register("daily_bars", statement(BARS, "bars", "symbol, date, volume", PRICES))
def _(spark, d):
    return bars(spark, d)


@register("daily_bars_of_events", statement(EVENT_BARS, "bars", "symbol, date, volume", PRICES))
def _(spark, d):
    return daily_events(spark, d)


@register("symbol_list", "SELECT DISTINCT l_suppkey AS symbol FROM lineitem")
def _(spark, d):
    return sc.symbol_list(trades(table(spark, d, "lineitem")))


@register(
    "symbols_without_recent_bars",
    f"""SELECT s_suppkey AS symbol FROM supplier WHERE s_suppkey NOT IN (
    SELECT l_suppkey FROM lineitem WHERE CAST(l_shipdate AS DATE) >= {NEWEST} - 3)""",
)
def _(spark, d):
    master = table(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol"))
    recent = trades(table(spark, d, "lineitem")).filter(F.col("date") >= F.date_sub(as_of(spark, d), 3))
    return sc.uncovered(master, recent)


@register(
    "bars_of_one_symbol",
    statement(BARS, "bars", "symbol, date, volume", PRICES, where="WHERE symbol = 7", tail="ORDER BY date LIMIT 100"),
)
def _(spark, d):
    return sc.one_symbol(bars(spark, d), 7, limit=100)


# --- duplicates and gaps ------------------------------------------------------

def _dedupe_sql(direction):
    return statement(
        f"""r AS (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date,
    l_extendedprice / l_quantity AS price, l_quantity AS volume,
    row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE)
      ORDER BY l_orderkey {direction}, l_linenumber {direction}, l_partkey {direction},
               l_extendedprice {direction}) AS rn FROM lineitem)""",
        "r", "symbol, date", ["price", "volume"], where="WHERE rn = 1",
    )


@register("duplicates_keep_first", _dedupe_sql("ASC"))
def _(spark, d):
    return dedupe(trades(table(spark, d, "lineitem")), keep="first")


@register("duplicates_keep_last", _dedupe_sql("DESC"))
def _(spark, d):
    return dedupe(trades(table(spark, d, "lineitem")), keep="last")


@register(
    "fill_gaps",
    statement(
        [BARS, "gaps AS (SELECT symbol, date, CASE WHEN volume % 3 > 0 THEN close END AS close FROM bars)"],
        "gaps", "symbol, date",
        {"close": f"""coalesce(last_value(close IGNORE NULLS) OVER {SO_FAR},
          first_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""},
    ),
)
def _(spark, d):
    gaps = bars(spark, d).select(
        "symbol", "date", F.when(F.col("volume") % 3 > 0, F.col("close")).alias("close")
    )
    return clean.forward_backward_fill(gaps, ["close"])


SHIFTED = f"""shifted AS (SELECT symbol, date, open - 1400 AS open, high - 1400 AS high,
  low - 1400 AS low, close - 1400 AS close, volume FROM bars)"""
SQUASHED = "squashed AS (SELECT symbol, date, open, least(high, open * 1.01) AS high, low, close, volume FROM bars)"


@register(
    "positive_prices",
    statement([BARS, SHIFTED], "shifted", "symbol, date, volume", PRICES,
              where="WHERE open > 0 AND high > 0 AND low > 0 AND close > 0"),
)
def _(spark, d):
    moved = bars(spark, d).withColumns({c: F.col(c) - 1400 for c in PRICES})
    return clean.positive_prices(moved)


CONSISTENT = "WHERE NOT (high < low OR high < open OR high < close OR low > open OR low > close)"


@register(
    "consistent_prices",
    statement([BARS, SQUASHED], "squashed", "symbol, date, volume", PRICES, where=CONSISTENT),
)
def _(spark, d):
    return clean.consistent_prices(
        bars(spark, d).withColumn("high", F.least("high", F.col("open") * 1.01))
    )


IQR = """quartiles AS (SELECT symbol, quantile_cont(close, 0.25) AS q1, quantile_cont(close, 0.75) AS q3
  FROM {src} GROUP BY symbol)"""


@register(
    "drop_outliers",
    statement([BARS, IQR.format(src="bars")], "bars JOIN quartiles USING (symbol)", "symbol, date, volume",
              PRICES, where="WHERE close BETWEEN q1 - 0.5 * (q3 - q1) AND q3 + 0.5 * (q3 - q1)"),
)
def _(spark, d):
    return clean.drop_outliers(bars(spark, d), threshold=0.5)


@register(
    "clean_bars",
    statement(
        [BARS, f"ok AS (SELECT * FROM bars {CONSISTENT} AND open > 0 AND high > 0 AND low > 0 AND close > 0)",
         IQR.format(src="ok")],
        "ok JOIN quartiles USING (symbol)", "symbol, date, volume", PRICES,
        where="WHERE close BETWEEN q1 - 3 * (q3 - q1) AND q3 + 3 * (q3 - q1)",
    ),
)
def _(spark, d):
    return clean.clean_bars(bars(spark, d))


@register(
    "coerce_text_rows",
    statement("""typed AS (SELECT l_suppkey AS symbol,
        TRY_CAST(CASE WHEN l_linenumber = 7 THEN 'not a date' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS DATE) AS date,
        l_extendedprice AS open, l_extendedprice AS high,
        TRY_CAST(CASE WHEN l_linestatus = 'O' THEN 'n/a' ELSE CAST(l_tax AS VARCHAR) END AS DOUBLE) AS low,
        l_extendedprice AS close, CAST(TRY_CAST(CAST(l_quantity AS VARCHAR) AS DOUBLE) AS BIGINT) AS volume
      FROM lineitem)""", "typed", "symbol, CAST(date AS DATE) AS date, volume", PRICES,
              where="WHERE date IS NOT NULL AND low IS NOT NULL AND volume IS NOT NULL"),
)
def _(spark, d):
    li = table(spark, d, "lineitem")
    text = li.select(
        F.col("l_suppkey").alias("symbol"),
        F.when(F.col("l_linenumber") == 7, "not a date").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("date"),
        *[F.col("l_extendedprice").cast("string").alias(c) for c in ("open", "high", "close")],
        F.when(F.col("l_linestatus") == "O", "n/a").otherwise(F.col("l_tax").cast("string")).alias("low"),
        F.col("l_quantity").cast("string").alias("volume"),
    )
    return clean.coerce_bars(text)


# --- slices ------------------------------------------------------------------------

@register(
    "last_year_of_bars",
    statement(BARS, "bars", "symbol, date, volume", PRICES, where=f"WHERE date >= {NEWEST} - 365"),
)
def _(spark, d):
    return clean.within_period(bars(spark, d), "1y", as_of(spark, d))


@register(
    "bars_between_dates",
    statement(BARS, "bars", "symbol, date, volume", PRICES, where="WHERE date BETWEEN DATE '1997-03-01' AND DATE '1997-09-30'"),
)
def _(spark, d):
    return clean.between_dates(bars(spark, d), "1997-03-01", "1997-09-30")


@register(
    "newest_rows_per_symbol",
    statement([BARS, f"r AS (SELECT *, row_number() OVER {DESC} AS rn FROM bars)"], "r", "symbol, date, volume",
              PRICES, where="WHERE rn <= 30"),
)
def _(spark, d):
    return clean.newest_rows(bars(spark, d), 30)


BROKEN = """broken AS (SELECT symbol, date, CASE WHEN volume % 5 = 0 THEN CAST('inf' AS DOUBLE)
  WHEN volume % 7 = 0 THEN CAST('nan' AS DOUBLE) ELSE close END AS close FROM bars)"""


def _broken(spark, d):
    v = F.col("volume")
    close = F.when(v % 5 == 0, float("inf")).when(v % 7 == 0, float("nan")).otherwise(F.col("close"))
    return bars(spark, d).select("symbol", "date", close.alias("close"))


@register(
    "unusable_numbers_to_null",
    statement([BARS, BROKEN], "broken", "symbol, date",
              {"close": "CASE WHEN isfinite(close) THEN close END",
               "close_or_zero": "CASE WHEN isfinite(close) THEN close ELSE 0 END"}),
)
def _(spark, d):
    df = _broken(spark, d).withColumn("close_or_zero", scalars.finite_or("close", 0.0))
    return scalars.finite_columns(df, ["close"])


@register(
    "training_rows",
    statement([BARS, BROKEN, f"t AS (SELECT *, {lead('close')} AS target FROM broken)"], "t", "symbol, date",
              ["close", "target"], where="WHERE isfinite(close) AND isfinite(target)"),
)
def _(spark, d):
    df = _broken(spark, d).withColumn("target", nxt("close"))
    return clean.training_rows(df, ["close", "target"])


@register(
    "symbols_with_history",
    statement([BARS, f"c AS (SELECT *, count(*) OVER {SERIES} AS n FROM bars)"], "c", "symbol, date",
              ["close"], where="WHERE n >= 530"),
)
def _(spark, d):
    return clean.min_history(bars(spark, d), 530).select("symbol", "date", "close")


@register("sampled_symbols")
def _(spark, d):
    return clean.sample_symbols(bars(spark, d), 10, seed=42)


@register(
    "symbol_search",
    statement(EVENT_BARS, "bars", "symbol, date", ["close"], where="WHERE symbol LIKE '%i%'"),
)
def _(spark, d):
    return clean.search_symbols(daily_events(spark, d), "I").select("symbol", "date", "close")


@register(
    "train_test_split",
    statement([BARS, f"s AS (SELECT *, row_number() OVER {W} AS rn, count(*) OVER {SERIES} AS n FROM bars)"], "s",
              "symbol, date, CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS part", ["close"]),
)
def _(spark, d):
    return clean.ordered_split(bars(spark, d)).select("symbol", "date", "part", "close")


@register(
    "rows_before_date_cutoff",
    statement(
        [BARS, """cut AS (SELECT DATE '1970-01-01' + CAST(floor(quantile_cont(date - DATE '1970-01-01', 0.8)) AS INTEGER) AS d
          FROM bars)"""],
        "bars", "symbol, count(*) AS train_rows", where="WHERE date < (SELECT d FROM cut)", tail="GROUP BY symbol",
    ),
)
def _(spark, d):
    b = bars(spark, d)
    return b.filter(F.col("date") < clean.date_cutoff(b)).groupBy("symbol").agg(F.count(F.lit(1)).alias("train_rows"))


@register(
    "calendar_features",
    statement(
        BARS, "bars",
        """symbol, date, year(date) AS year, month(date) AS month, day(date) AS day,
        isodow(date) - 1 AS day_of_week, quarter(date) AS quarter, dayofyear(date) AS day_of_year,
        weekofyear(date) AS week_of_year, CAST(day(date) = 1 AS INTEGER) AS is_month_start,
        CAST(date = last_day(date) AS INTEGER) AS is_month_end,
        CAST(day(date) = 1 AND month(date) IN (1, 4, 7, 10) AS INTEGER) AS is_quarter_start,
        CAST(date = last_day(date) AND month(date) IN (3, 6, 9, 12) AS INTEGER) AS is_quarter_end""",
        {"day_sin": "sin(2 * pi() * (isodow(date) - 1) / 7)", "day_cos": "cos(2 * pi() * (isodow(date) - 1) / 7)",
         "month_sin": "sin(2 * pi() * month(date) / 12)", "month_cos": "cos(2 * pi() * month(date) / 12)"},
    ),
)
def _(spark, d):
    return scalars.calendar_features(bars(spark, d)).drop("open", "high", "low", "close", "volume")


# --- upkeep ------------------------------------------------------------------------

SPLIT = f"""numbered AS (SELECT *, row_number() OVER {DESC} AS rn FROM bars),
stored AS (SELECT {BAR_COLS} FROM numbered WHERE rn > 20),
batch AS (SELECT {BAR_COLS} FROM numbered WHERE rn <= 25
  UNION ALL SELECT symbol + 1000000, date, open, high, low, close + 1, volume FROM numbered WHERE rn <= 5)"""


def stored_and_batch(spark, d):
    """All but the newest 20 bars per symbol, and a batch that overlaps them by five."""
    from barloom.functions.series import series

    numbered = bars(spark, d).withColumn("rn", F.row_number().over(series(newest_first=True)))
    stored = numbered.filter("rn > 20").drop("rn")
    unseen = numbered.filter("rn <= 5").drop("rn").withColumns(
        {"symbol": F.col("symbol") + 1000000, "close": F.col("close") + 1}
    )
    return stored, numbered.filter("rn <= 25").drop("rn").unionByName(unseen)


def kept_stored_and_batch(spark, d):
    """The same two tables, written once for jobs that pass over them several times."""
    def kept(df, purpose):
        path = fresh_path(spark, purpose)
        df.write.parquet(path)
        return spark.read.parquet(path)

    stored, batch = stored_and_batch(spark, d)
    return kept(stored, "stored"), kept(batch, "batch")


@register(
    "pending_bars",
    statement([BARS, SPLIT, "last AS (SELECT symbol, max(date) AS d FROM stored GROUP BY symbol)"],
              "batch LEFT JOIN last USING (symbol)", "symbol, date, volume", PRICES, where="WHERE d IS NULL OR date > d"),
)
def _(spark, d):
    stored, batch = stored_and_batch(spark, d)
    return upkeep.pending_bars(batch, stored)


@register(
    "upsert_bars",
    statement(
        [BARS, SPLIT, """changes AS (SELECT * REPLACE (close * 1.01 AS close) FROM batch),
          u AS (SELECT *, 0 AS seq FROM stored UNION ALL SELECT *, 1 AS seq FROM changes),
          r AS (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY seq DESC) AS rn FROM u)"""],
        "r", "symbol, date, volume", PRICES, where="WHERE rn = 1"),
)
def _(spark, d):
    stored, batch = stored_and_batch(spark, d)
    changes = batch.withColumns({"close": F.col("close") * 1.01, "seq": F.lit(1)})
    return upkeep.upsert(stored.withColumn("seq", F.lit(0)), changes, ["symbol", "date"], "seq")


@register(
    "refresh_symbols",
    statement(
        [BARS, SPLIT, """incoming AS (SELECT * FROM batch WHERE date >= DATE '2001-09-01'),
          named AS (SELECT DISTINCT symbol FROM incoming),
          r AS (SELECT s.* FROM stored s ANTI JOIN named n ON s.symbol = n.symbol UNION ALL SELECT * FROM incoming)"""],
        "r", "symbol, date, volume", PRICES),
)
def _(spark, d):
    stored, batch = stored_and_batch(spark, d)
    incoming = batch.filter("date >= '2001-09-01'").withColumn("seq", F.lit(1))
    return upkeep.refresh_symbols(stored, incoming, "seq")


@register(
    "retention_kept",
    statement(BARS, "bars", "symbol, date", ["close"], where=f"WHERE date >= {NEWEST} - 730"),
)
def _(spark, d):
    return upkeep.retain(bars(spark, d), 730, as_of(spark, d)).select("symbol", "date", "close")


@register(
    "retention_deleted",
    statement(BARS, "bars", f"""count(*) FILTER (WHERE date < {NEWEST} - 730) AS deleted,
      count(*) FILTER (WHERE date >= {NEWEST} - 730) AS kept"""),
)
def _(spark, d):
    return upkeep.expired_count(bars(spark, d), 730, as_of(spark, d))


META_SQL = statement(BARS, "bars", "symbol, count(*) AS record_count, max(date) AS last_date",
                     {"last_close": "arg_max(close, date)"}, tail="GROUP BY symbol")


@register("symbol_metadata", META_SQL)
def _(spark, d):
    return sc.symbol_metadata(bars(spark, d))


@register(
    "latest_sync_records",
    statement([BARS, f"m AS (SELECT symbol, max(date) AS last_date, count(*) AS record_count FROM bars GROUP BY symbol)"],
              "m", "symbol, record_count, last_date", tail="ORDER BY last_date DESC, symbol LIMIT 10"),
)
def _(spark, d):
    meta = sc.symbol_metadata(bars(spark, d)).drop("last_close")
    return sc.ranked(meta, "last_date", ascending=False).limit(10)


@register(
    "symbol_codes",
    "SELECT symbol, dense_rank() OVER (ORDER BY symbol) - 1 AS symbol_code FROM (SELECT DISTINCT l_suppkey AS symbol FROM lineitem)",
)
def _(spark, d):
    return upkeep.symbol_codes(trades(table(spark, d, "lineitem")))
