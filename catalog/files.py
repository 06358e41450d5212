"""CSV, JSON and store round trips over bars derived from the given tables."""

from pyspark.sql import functions as F

from barloom.functions.series import nxt, prev, series
from barloom.operators.clean import feature_columns, features_or_zero, rename_columns
from barloom.operators.strategies import adjust_strategies
from barloom.shared import fresh_path
from barloom.sources import bar_csv, files, store
from barloom.sources.versions import VersionedBars
from catalog.bars import SPLIT, kept_stored_and_batch, stored_and_batch
from catalog.forecasts import ADJUST_NUM, ADJUST_SQL, BOOK_SQL, MADE
from catalog.registry import BARS, VALIDATION_CTES, W, bars, forecasts, lag, lead, register, scored, statement

PRICES = ["open", "high", "low", "close"]
CELLS = ["date", *PRICES, "volume"]

# --- CSV ------------------------------------------------------------------------

#: Header lines by ``symbol % 4``, and the order of the cells below them.
LAYOUTS = [
    (["Date,Open,High,Low,Close,Volume"], CELLS),
    (["Price,Close,High,Low,Open,Volume", "Ticker,X.NS,X.NS,X.NS,X.NS,X.NS", "Date,,,,,"], ["date", "close", "high", "low", "open", "volume"]),
    (["Date,Adj Close,Close,High,Low,Open,Volume", ",X.NS,X.NS,X.NS,X.NS,X.NS,X.NS"], ["date", "nothing", "close", "high", "low", "open", "volume"]),
    ([",".join([f"note {i}" for i in range(20)] + [" DATETIME ", '"OPEN"', "high", "Low", "cLose", "volume"])], [*["nothing"] * 20, *CELLS]),
]


def _written(df, spark, layout_of, headers, orders):
    """One text file per symbol: its header lines and its rows in the order of its layout. A series is bounded by the calendar."""
    cells = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in CELLS} | {"nothing": F.lit("")}
    line = F.lit(None)
    head = F.lit(None)
    for k, (top, order) in enumerate(zip(headers, orders)):
        line = F.when(layout_of == k, F.concat_ws(",", *[cells[c] for c in order])).otherwise(line)
        head = F.when(layout_of == k, F.lit("".join(f"{h}\n" for h in top))).otherwise(head)
    lines = df.select("symbol", head.alias("head"), F.struct("rn", line.alias("line")).alias("l"))
    whole = lines.groupBy("symbol").agg(F.first("head").alias("head"), F.sort_array(F.collect_list("l")).alias("ls"))
    path = fresh_path(spark, "eod")
    text = F.concat("head", F.array_join(F.col("ls.line"), "\n"))
    whole.select("symbol", text.alias("value")).write.partitionBy("symbol").text(path)
    return path


def _numbered(spark, d):
    return bars(spark, d).withColumn("rn", F.row_number().over(series()))


@register("csv_round_trip", statement(BARS, "bars", "symbol, date, volume", PRICES))
def _(spark, d):
    df = _numbered(spark, d)
    path = _written(df, spark, F.col("symbol") % 4, [t for t, _ in LAYOUTS], [o for _, o in LAYOUTS])
    return bar_csv.scan(spark, path, glob="*").bars.drop("seq").withColumn("symbol", F.col("symbol").cast("long"))


@register("csv_export", statement(BARS, "bars", "symbol, date, volume", PRICES))
def _(spark, d):
    path = fresh_path(spark, "export")
    store.export_csv(bars(spark, d), path)
    return files.read_bars_csv(spark, path).withColumn("symbol", F.col("symbol").cast("long"))


# Spoiled cells by row number modulo 50: the cell, what stands in it, and the reason given.
SPOILED = {
    7: ("date", "soon", "unreadable date"), 11: ("close", "n/a", "unreadable close"), 17: ("volume", "NaN", "unreadable volume"),
    23: ("open", "", "no open"), 29: ("high", "Infinity", "unreadable high"), 31: ("volume", "1e40", "unreadable volume"), 37: ("low", "1;5", "unreadable low"),
}
# Headers by symbol modulo 10, else the plain one.
HEADERS = {3: "Date,Open,High,Low,Close,Shares", 5: "", 7: "Datetime,OPEN,High,Low,Close,Volume", 8: "Date,Open,High,Low,Adj Close,Volume"}
FILE_REASONS = {3: "missing columns: volume", 5: "no header", 8: "missing columns: close"}


def _spoiled(spark, d):
    df = _numbered(spark, d).withColumns({c: F.col(c).cast("string") for c in CELLS})
    for k, (column, text, _) in SPOILED.items():
        df = df.withColumn(column, F.when(F.col("rn") % 50 == k, F.lit(text)).otherwise(F.col(column)))
    kinds = sorted(HEADERS)
    layout = F.lit(len(kinds))
    for i, k in enumerate(kinds):
        layout = F.when(F.col("symbol") % 10 == k, i).otherwise(layout)
    headers = [[HEADERS[k]] for k in kinds] + [LAYOUTS[0][0]]
    path = _written(df, spark, layout, headers, [CELLS] * len(headers))
    return bar_csv.scan(spark, path, glob="*", min_rows=20)


_SPOILED_CTE = f"""numbered AS (SELECT *, row_number() OVER {W} AS rn FROM bars),
judged AS (SELECT *, CASE rn % 50 {' '.join(f"WHEN {k} THEN '{r}'" for k, (_, _, r) in SPOILED.items())} END AS reason,
  CASE symbol % 10 {' '.join(f"WHEN {k} THEN '{r}'" for k, r in FILE_REASONS.items())} END AS file_reason FROM numbered),
per_file AS (SELECT symbol, count(*) AS lines, count(*) FILTER (WHERE file_reason IS NULL AND reason IS NULL) AS bars,
  count(*) FILTER (WHERE file_reason IS NULL AND reason IS NOT NULL) AS rejected, any_value(file_reason) AS file_reason FROM judged GROUP BY symbol)"""


@register("csv_rejects", statement([BARS, _SPOILED_CTE], "judged", f"""symbol, reason,
  CASE rn % 50 WHEN 7 THEN 'soon' ELSE CAST(date AS VARCHAR) END AS first_cell""", where="WHERE file_reason IS NULL AND reason IS NOT NULL"))
def _(spark, d):
    return _spoiled(spark, d).rejects.select(
        F.col("symbol").cast("long").alias("symbol"), "reason", F.split("line", ",")[0].alias("first_cell"))


@register("csv_file_report", statement([BARS, _SPOILED_CTE], "per_file", """symbol, lines, bars, rejected,
  coalesce(file_reason, CASE WHEN bars < 20 THEN 'fewer than 20 rows' END) AS reason"""))
def _(spark, d):
    return _spoiled(spark, d).files.select(F.col("symbol").cast("long").alias("symbol"), "lines", "bars", "rejected", "reason")


@register("csv_clean_rows", statement([BARS, _SPOILED_CTE], "judged JOIN per_file USING (symbol)", "symbol, date, volume", PRICES,
                                      where="WHERE judged.file_reason IS NULL AND reason IS NULL AND per_file.bars >= 20"))
def _(spark, d):
    return _spoiled(spark, d).bars.drop("seq").withColumn("symbol", F.col("symbol").cast("long"))


@register("symbol_master_round_trip", "SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS symbol FROM lineitem")
def _(spark, d):
    path = fresh_path(spark, "master")
    names = bars(spark, d).select(F.concat(F.lit(" "), F.col("symbol").cast("string")).alias("SYMBOL"), F.lit("x").alias("NAME"))
    names.write.option("header", True).csv(path)
    return files.read_symbol_master(spark, path)


# --- JSON ------------------------------------------------------------------------

@register("forecast_history_round_trip", statement(MADE, "forecasts", """CAST(symbol AS VARCHAR) AS symbol, made_on, made_on + 1 AS prediction_date,
  model_used, symbol % 2 = 0 AS validated, CASE WHEN symbol % 2 = 0 THEN 'accurate' END AS status""",
          ["current_price", "predicted_price", "predicted_change_pct", "confidence"]))
def _(spark, d):
    made = forecasts(spark, d)
    checked = F.col("symbol") % 2 == 0
    entry = F.struct("predicted_price", "current_price", F.col("predicted_change_pct").alias("predicted_change"), "confidence",
                     F.col("model_used").alias("model"), checked.alias("validated"),
                     F.when(checked, F.struct(F.lit("accurate").alias("status"))).alias("validation"))
    # One document line per symbol; a symbol's days are bounded by the calendar.
    by_day = made.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct(F.col("made_on").cast("string"), entry))).alias("days"))
    path = fresh_path(spark, "history")
    by_day.select(F.to_json(F.create_map(F.col("symbol").cast("string"), "days")).alias("value")).write.text(path)
    rows = files.read_forecast_history(spark, path, one_document_per_file=False)
    return rows.withColumn("status", F.col("validation.status")).drop("validation")


@register("strategies_round_trip", statement([VALIDATION_CTES, BOOK_SQL, ADJUST_SQL], "adjusted", "name, enabled", ADJUST_NUM))
def _(spark, d):
    path = fresh_path(spark, "strategies")
    files.write_strategies(adjust_strategies(scored(spark, d)), path)
    return files.read_strategies(spark, path)


# --- columns ------------------------------------------------------------------------

@register("columns_renamed", statement(BARS, "bars", "symbol, date, volume AS traded", PRICES))
def _(spark, d):
    df = bars(spark, d)
    loud = df.withColumnsRenamed({c: f" {c.title()} " for c in df.columns if c != "volume"} | {"volume": "Volume Traded"})
    return rename_columns(loud, {"Volume Traded": "traded"})


@register("feature_columns_kept", statement([BARS, f"t AS (SELECT *, {lag('close')} AS close_lag_1, {lead('close')} AS target FROM bars)"], "t", "symbol, date",
                                            {"close_lag_1": "close_lag_1"}))
def _(spark, d):
    df = bars(spark, d).withColumns({"close_lag_1": prev("close"), "target": nxt("close"), "note": F.lit(1.0)})
    return df.select("symbol", "date", *feature_columns(df, exclude=["note"]))


@register("missing_features_as_zero", statement([BARS, f"t AS (SELECT *, {lag('close')} AS close_lag_1 FROM bars)"], "t", "symbol, date",
                                                {"close_lag_1": "coalesce(close_lag_1, 0)", "rsi_14": "0", "close": "close"}))
def _(spark, d):
    df = bars(spark, d).withColumn("close_lag_1", prev("close"))
    return features_or_zero(df, ["close_lag_1", "rsi_14", "close"]).select("symbol", "date", "close_lag_1", "rsi_14", "close")


# --- versioned store ------------------------------------------------------------------------

SYNCED = ["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04"]


def _versioned(spark, d):
    """Bars created, appended twice with repeated rows, corrected, and some symbols replaced."""
    stored, batch = kept_stored_and_batch(spark, d)
    table = VersionedBars(spark, fresh_path(spark, "versions"), rows_per_file=2000)
    table.create(stored, synced_at=SYNCED[0])
    twice = batch.withColumn("seq", F.lit(2)).unionByName(batch.withColumns({"close": F.col("close") - 1, "seq": F.lit(1)}))
    for _ in range(2):
        table.append(twice, "seq", SYNCED[1])
    table.merge(batch.filter("symbol % 7 = 1").withColumn("close", F.col("close") * 1.5), synced_at=SYNCED[2])
    table.replace(stored.filter("symbol % 5 = 2 AND date < DATE '1996-01-01'"), synced_at=SYNCED[3])
    return table


_AFTER = f"""last AS (SELECT symbol, max(date) AS d FROM stored GROUP BY symbol),
appended AS (SELECT * FROM stored UNION ALL SELECT b.* FROM batch b LEFT JOIN last USING (symbol) WHERE d IS NULL OR b.date > d)"""
_MERGED = f"""{_AFTER},
changes AS (SELECT * REPLACE (close * 1.5 AS close) FROM batch WHERE symbol % 7 = 1),
merged AS (SELECT a.* FROM appended a ANTI JOIN changes c ON a.symbol = c.symbol AND a.date = c.date UNION ALL SELECT * FROM changes),
fresh AS (SELECT * FROM stored WHERE symbol % 5 = 2 AND date < DATE '1996-01-01'),
now_rows AS (SELECT m.* FROM merged m ANTI JOIN (SELECT DISTINCT symbol FROM fresh) f ON m.symbol = f.symbol UNION ALL SELECT * FROM fresh)"""


@register("append_with_duplicates", statement([BARS, SPLIT, _AFTER], "appended", "symbol, date, volume", PRICES))
def _(spark, d):
    stored, batch = stored_and_batch(spark, d)
    target = fresh_path(spark, "store")
    store.write_bars(stored, target, 8)
    older = batch.withColumns({"close": F.col("close") - 1, "seq": F.lit(1)})
    store.append_pending(spark, target, older.unionByName(batch.withColumn("seq", F.lit(2))), 8, seq="seq")
    return store.read_bars(spark, target)


@register("versioned_bars", statement([BARS, SPLIT, _MERGED], "now_rows", "symbol, date, volume", PRICES))
def _(spark, d):
    return _versioned(spark, d).read()


@register("versioned_symbols_between", statement([BARS, SPLIT, _MERGED], "now_rows", "symbol, date, volume", PRICES,
                                                 where="WHERE symbol IN (2, 8, 9) AND date BETWEEN DATE '1994-03-01' AND DATE '1998-03-01'"))
def _(spark, d):
    return _versioned(spark, d).read([2, 8, 9], "1994-03-01", "1998-03-01")


@register("versioned_state", statement([BARS, SPLIT, _MERGED], "now_rows LEFT JOIN last USING (symbol)", f"""symbol, count(*) AS record_count,
  max(date) AS last_date, strftime(any_value(CASE WHEN symbol IN (SELECT symbol FROM fresh) THEN DATE '{SYNCED[3]}'
    WHEN symbol IN (SELECT symbol FROM changes) THEN DATE '{SYNCED[2]}' ELSE DATE '{SYNCED[1]}' END), '%Y-%m-%d') AS synced""",
          {"last_close": "arg_max(close, date)"}, tail="GROUP BY symbol"))
def _(spark, d):
    return _versioned(spark, d).state().select(
        "symbol", "record_count", "last_date", "last_close", F.date_format("last_sync", "yyyy-MM-dd").alias("synced"))


@register("versioned_compacted", statement([BARS, SPLIT, _MERGED, "newest AS (SELECT max(date) AS d FROM now_rows)"], "now_rows, newest",
                                           "symbol, date, volume", PRICES, where="WHERE date >= newest.d - 1500"))
def _(spark, d):
    table = _versioned(spark, d)
    table.compact()
    table.retain(1500)
    return table.read()
