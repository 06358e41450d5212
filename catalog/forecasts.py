"""Forecasts, scoring and accuracy reports."""

from pyspark.sql import functions as F

from barloom.operators import forecast as fc
from barloom.operators import strategies as st
from barloom.operators import validation as val
from barloom.plans import cycles
from catalog.registry import (
    DESC, FORECAST_CTE, NEXT_BAR_CTE, SCORED_CTE, TAME, VALIDATION_CTES, W, forecasts, lead, register, scored, statement, tame,
)

FC_NUM = ["current_price", "predicted_price", "predicted_change_pct", "confidence"]
MADE = f"{TAME},\n{FORECAST_CTE}"
NEWEST_CTE = f"""newest AS (SELECT * FROM (SELECT *, row_number() OVER
  (PARTITION BY symbol ORDER BY prediction_date DESC) AS rn FROM forecasts) WHERE rn = 1)"""


@register("trend_forecast", statement([MADE, NEWEST_CTE], "newest", "symbol, prediction_date, 'Simple_MA_Trend' AS model_used", FC_NUM))
def _(spark, d):
    return fc.trend_forecast(tame(spark, d))


@register("trend_forecast_history", statement(MADE, "forecasts", "symbol, made_on, prediction_date, model_used", FC_NUM))
def _(spark, d):
    return forecasts(spark, d)


@register("latest_forecasts", statement([MADE, NEWEST_CTE], "newest", "symbol, made_on, prediction_date, model_used", FC_NUM))
def _(spark, d):
    return val.predictions_on(forecasts(spark, d))


@register("latest_forecasts_by_semi_join",
          statement(MADE, "forecasts", "symbol, made_on, prediction_date, model_used", FC_NUM,
                    where="WHERE (symbol, prediction_date) IN (SELECT symbol, max(prediction_date) FROM forecasts GROUP BY symbol)"))
def _(spark, d):
    return val.latest_by_semi_join(forecasts(spark, d))


@register("forecasts_on_date", statement(MADE, "forecasts", "symbol, made_on, prediction_date, model_used", FC_NUM, where="WHERE prediction_date = DATE '1998-06-02'"))
def _(spark, d):
    return val.predictions_on(forecasts(spark, d), "1998-06-02")


@register("forecast_for_symbol", statement([MADE, NEWEST_CTE], "newest", "symbol, made_on, prediction_date, model_used", FC_NUM, where="WHERE symbol = 5"))
def _(spark, d):
    return val.prediction_for(forecasts(spark, d), 5)


@register("forecast_stats", statement([MADE, NEWEST_CTE], "newest", "count(*) AS total_predictions, count(DISTINCT symbol) AS unique_stocks, max(prediction_date) AS latest_prediction_date"))
def _(spark, d):
    return val.prediction_stats(val.predictions_on(forecasts(spark, d)))


@register("symbols_without_forecast",
          statement(MADE, "bars", "DISTINCT symbol", where="WHERE symbol NOT IN (SELECT symbol FROM forecasts WHERE prediction_date >= DATE '2001-10-15')"))
def _(spark, d):
    from barloom.operators.screens import symbol_list, uncovered

    made = forecasts(spark, d).filter(F.col("prediction_date") >= F.lit("2001-10-15").cast("date"))
    return uncovered(symbol_list(tame(spark, d)), made)


# --- three models per symbol, for ensembles and model choice ----------------------------

LONG_SQL = """long AS (SELECT symbol, prediction_date, current_price, confidence, predicted_price, 'trend' AS model FROM forecasts
  UNION ALL SELECT symbol, prediction_date, current_price, 60, current_price, 'naive' FROM forecasts
  UNION ALL SELECT symbol, prediction_date, current_price, 50, current_price * 1.01, 'drift' FROM forecasts)"""


def _long(spark, d):
    base = forecasts(spark, d)
    cols = ["symbol", "made_on", "prediction_date", "current_price"]
    options = F.array(
        F.struct(F.lit("trend").alias("model"), F.col("predicted_price").alias("p"), F.col("confidence").alias("c")),
        F.struct(F.lit("naive").alias("model"), F.col("current_price").alias("p"), F.lit(60.0).alias("c")),
        F.struct(F.lit("drift").alias("model"), (F.col("current_price") * 1.01).alias("p"), F.lit(50.0).alias("c")),
    )
    long = base.select(*cols, F.explode(options).alias("o"))
    return long.select(*cols, F.col("o.model").alias("model"), F.col("o.p").alias("predicted_price"), F.col("o.c").alias("confidence"))


@register(
    "meta_ensemble",
    statement([MADE, LONG_SQL, """e AS (SELECT symbol, prediction_date, max(current_price) AS current_price,
      sum(predicted_price * confidence) / sum(confidence) AS predicted_price, avg(confidence) AS confidence, count(*) AS models
      FROM long GROUP BY ALL)"""], "e", "symbol, prediction_date, models, 'ensemble_meta' AS model_used",
      {"current_price": "current_price", "predicted_price": "predicted_price", "confidence": "confidence",
       "predicted_change_pct": "(predicted_price - current_price) / current_price * 100"}),
)
def _(spark, d):
    return fc.meta_ensemble(_long(spark, d))


ERR_SQL = f"""nextbar AS (SELECT symbol, date + 1 AS prediction_date, {lead('close')} AS actual FROM bars),
errs AS (SELECT l.model, l.symbol, l.predicted_price / l.current_price - 1 AS p, n.actual / l.current_price - 1 AS a,
  l.predicted_price AS pp, n.actual AS aa
  FROM long l JOIN nextbar n USING (symbol, prediction_date) WHERE n.actual IS NOT NULL),
metrics AS (SELECT model, count(*) AS n, avg((aa - pp) ^ 2) AS mse, sqrt(avg((aa - pp) ^ 2)) AS rmse, avg(abs(aa - pp)) AS mae,
  1 - sum((aa - pp) ^ 2) / (var_pop(aa) * count(*)) AS r2, avg(abs((aa - pp) / aa)) * 100 AS mape,
  greatest(0, 100 - avg(abs((aa - pp) / aa)) * 100) AS accuracy,
  avg(CASE WHEN (pp > 0) = (aa > 0) THEN 1 ELSE 0 END) * 100 AS direction_accuracy FROM errs GROUP BY model)"""
METRIC_COLS = ["mse", "rmse", "mae", "r2", "mape", "accuracy", "direction_accuracy"]


def _metrics(spark, d):
    matched = val.match_next_bar(_long(spark, d), tame(spark, d))
    return fc.regression_metrics(matched, "actual_price", "predicted_price", by=["model"])


@register("regression_metrics", statement([MADE, LONG_SQL, ERR_SQL], "metrics", "model, n", METRIC_COLS))
def _(spark, d):
    return _metrics(spark, d)


@register("best_model", statement([MADE, LONG_SQL, ERR_SQL], "metrics", "arg_max(model, accuracy) AS best_model, count(*) AS models", {"best_score": "max(accuracy)"}))
def _(spark, d):
    return fc.best_model(_metrics(spark, d))


@register("model_report", statement([MADE, LONG_SQL, ERR_SQL], "metrics", "model",
          {"score": "accuracy / 100", "accuracy_pct": "accuracy", "weight": "accuracy / (SELECT sum(accuracy) FROM metrics)"}))
def _(spark, d):
    return fc.model_report(_metrics(spark, d))


@register("trend_lines", statement([TAME, f"t AS (SELECT *, {lead('close')} AS target FROM bars)"], "t", "symbol, count(*) AS n",
          {"slope": "regr_slope(target, close)", "intercept": "regr_intercept(target, close)"}, where="WHERE target IS NOT NULL", tail="GROUP BY symbol"))
def _(spark, d):
    return fc.trend_lines(tame(spark, d))


# --- scoring ------------------------------------------------------------------------------

SCORE_NUM = ["current_price", "predicted_price", "predicted_change_pct", "confidence", "actual_price", "price_error",
             "price_error_pct", "actual_change_pct", "accuracy_score", "accuracy"]
SCORE_KEY = "symbol, made_on, prediction_date, validation_date, model_used, direction_correct, status"


def _score_sql(matched):
    return statement([MADE, matched, SCORED_CTE], "scored", SCORE_KEY, SCORE_NUM)


EXACT = """matched AS (SELECT f.*, f.prediction_date AS validation_date, b.close AS actual_price
  FROM forecasts f JOIN bars b ON b.symbol = f.symbol AND b.date = f.prediction_date)"""
NEXT_DAY = """matched AS (SELECT f.*, b.date AS validation_date, b.close AS actual_price
  FROM forecasts f JOIN bars b ON b.symbol = f.symbol AND b.date = f.made_on + 1)"""
ASOF = """matched AS (SELECT f.*, b.date AS validation_date, b.close AS actual_price
  FROM forecasts f ASOF JOIN bars b ON b.symbol = f.symbol AND f.made_on < b.date)"""

for _name, _match, _sql in [("exact_date", "exact", EXACT), ("next_day", "next_day", NEXT_DAY),
                            ("next_bar", "next_bar", NEXT_BAR_CTE), ("asof", "asof", ASOF)]:
    register(f"scored_forecasts_{_name}", _score_sql(_sql))(lambda spark, d, m=_match: scored(spark, d, m))

ANCHOR = "(SELECT max(validation_date) FROM scored)"
RECENT = f"recent AS (SELECT * FROM scored WHERE validation_date >= {ANCHOR} - 365)"
HIT = "avg(CASE WHEN direction_correct THEN 100 ELSE 0 END)"


def _report_sql(plain, numbers, tail="", where="", source="recent", extra=()):
    return statement([VALIDATION_CTES, RECENT, *extra], source, plain, numbers, where=where, tail=tail)


@register("validation_history", _report_sql(SCORE_KEY, SCORE_NUM, where="WHERE model_used = 'model_1'"))
def _(spark, d):
    return val.history(scored(spark, d), model="model_1", days=365)


@register("validation_history_of_symbol", _report_sql(SCORE_KEY, SCORE_NUM, where="WHERE symbol = 11"))
def _(spark, d):
    return val.history(scored(spark, d), symbol=11, days=365)


@register("model_performance", _report_sql(
    "model_used, count(*) AS total_predictions, min(validation_date) AS first_prediction, max(validation_date) AS last_prediction",
    {"avg_accuracy": "avg(accuracy_score)", "direction_accuracy": HIT, "avg_error_pct": "avg(price_error_pct)", "avg_confidence": "avg(confidence)"},
    tail="GROUP BY model_used"))
def _(spark, d):
    return val.model_performance(scored(spark, d), days=365)


@register("top_symbols", _report_sql(
    "symbol, count(*) AS prediction_count, max(validation_date) AS last_validation",
    {"avg_metric": "avg(accuracy_score)", "direction_accuracy": HIT, "avg_confidence": "avg(confidence)"},
    tail="GROUP BY symbol HAVING count(*) >= 3 ORDER BY avg(accuracy_score) DESC, symbol LIMIT 10"))
def _(spark, d):
    return val.top_symbols(scored(spark, d), days=365)


TREND_NUM = {"avg_accuracy": "avg(accuracy_score)", "direction_accuracy": HIT, "avg_confidence": "avg(confidence)"}


@register("daily_accuracy_trend", _report_sql("validation_date, count(*) AS prediction_count", TREND_NUM, tail="GROUP BY validation_date"))
def _(spark, d):
    return val.daily_trend(scored(spark, d), days=365)


@register("daily_trend_by_model", _report_sql("model_used, validation_date, count(*) AS prediction_count", TREND_NUM, tail="GROUP BY model_used, validation_date"))
def _(spark, d):
    return val.daily_trend(scored(spark, d), days=365, by_model=True)


@register("accuracy_cube", _report_sql(
    "model_used, validation_date, CAST(grouping_id(model_used, validation_date) AS INTEGER) AS level, count(*) AS prediction_count",
    TREND_NUM | {"avg_error_pct": "avg(price_error_pct)"},
    tail="GROUP BY GROUPING SETS ((model_used, validation_date), (model_used), (validation_date), ())"))
def _(spark, d):
    return val.accuracy_cube(scored(spark, d), days=365)


@register("validation_run_summary", statement(VALIDATION_CTES, "scored", "count(*) AS total_validated",
          {"average_accuracy": "avg(accuracy_score)", "direction_accuracy": HIT, "average_price_error_pct": "avg(price_error_pct)"}))
def _(spark, d):
    return val.run_summary(scored(spark, d))


@register("model_comparison", statement([MADE, NEWEST_CTE], "newest", "model_used, count(*) AS count",
          {"avg_confidence": "avg(confidence)", "avg_predicted_change": "avg(predicted_change_pct)"}, tail="GROUP BY model_used"))
def _(spark, d):
    return val.model_comparison(val.predictions_on(forecasts(spark, d)))


@register("model_symbols", statement([MADE, NEWEST_CTE], "newest", "DISTINCT model_used, symbol"))
def _(spark, d):
    return val.model_symbols(val.predictions_on(forecasts(spark, d)))


RATES_SQL = f"""exact0 AS ({EXACT.split('AS (', 1)[1][:-1]}),
ev AS (SELECT *, (actual_price - current_price) / current_price * 100 AS actual_change_pct FROM exact0),
rates AS (SELECT v.model_used, avg(CASE WHEN abs(v.predicted_change_pct - v.actual_change_pct) < 5 THEN 1 ELSE 0 END) * 100 AS accuracy_rate,
  avg(abs(v.predicted_change_pct - v.actual_change_pct)) AS avg_error, count(*) AS validation_count
  FROM ev v JOIN forecasts p ON p.symbol = v.symbol AND p.prediction_date = v.validation_date GROUP BY v.model_used)"""


def _rates(spark, d):
    return val.hit_rates(forecasts(spark, d), scored(spark, d, "exact").drop("prediction_date"))


@register("hit_rates", statement([MADE, RATES_SQL], "rates", "model_used, validation_count", ["accuracy_rate", "avg_error"]))
def _(spark, d):
    return _rates(spark, d)


@register("mean_hit_rate", statement([MADE, RATES_SQL], "rates", "", {"avg_accuracy": "avg(accuracy_rate)"}))
def _(spark, d):
    return val.mean_hit_rate(_rates(spark, d))


@register("mean_symbol_accuracy", statement([VALIDATION_CTES, "s AS (SELECT avg(accuracy_score) AS a FROM scored GROUP BY symbol)"], "s", "", {"average_accuracy": "avg(a)"}))
def _(spark, d):
    return val.mean_symbol_accuracy(scored(spark, d))


@register("predictions_vs_actuals", _report_sql("count(*) AS total_predictions",
          {"correlation": "corr(predicted_price, actual_price)",
           "r2_score": "1 - sum((actual_price - predicted_price) ^ 2) / (var_pop(actual_price) * count(*))",
           "mean_accuracy": "avg(accuracy_score)", "std_accuracy": "stddev_samp(accuracy_score)"}))
def _(spark, d):
    return val.predictions_vs_actuals(scored(spark, d), days=365)


REPORT_SQL = """made AS (SELECT symbol, count(*) AS total_predictions FROM forecasts GROUP BY symbol),
rep AS (SELECT symbol, count(*) AS validated_predictions, avg(accuracy) AS avg_accuracy, max(accuracy) AS best_accuracy,
  min(accuracy) AS worst_accuracy, count(*) FILTER (WHERE status = 'accurate') AS accurate_count,
  count(*) FILTER (WHERE status = 'moderate') AS moderate_count, count(*) FILTER (WHERE status = 'poor') AS poor_count
  FROM scored GROUP BY symbol)"""
REPORT_KEY = "symbol, total_predictions, validated_predictions, accurate_count, moderate_count, poor_count"


@register("symbol_validation_report", statement([VALIDATION_CTES, REPORT_SQL], "made JOIN rep USING (symbol)", REPORT_KEY, ["avg_accuracy", "best_accuracy", "worst_accuracy"]))
def _(spark, d):
    return val.symbol_report(forecasts(spark, d), scored(spark, d))


# --- signals and strategies ------------------------------------------------------------------

SIGNAL_SQL = """CASE WHEN predicted_change_pct > 2 AND confidence > 70 THEN 'STRONG BUY' WHEN predicted_change_pct > 0.5 AND confidence > 60 THEN 'BUY'
  WHEN predicted_change_pct < -2 AND confidence > 70 THEN 'STRONG SELL' WHEN predicted_change_pct < -0.5 AND confidence > 60 THEN 'SELL' ELSE 'HOLD' END"""


@register("trading_signals", statement(MADE, "forecasts", f"""symbol, prediction_date, {SIGNAL_SQL} AS signal,
  CASE {SIGNAL_SQL} WHEN 'STRONG BUY' THEN 'Buy aggressively' WHEN 'BUY' THEN 'Consider buying' WHEN 'STRONG SELL' THEN 'Sell immediately'
  WHEN 'SELL' THEN 'Consider selling' ELSE 'Hold position' END AS action""", ["predicted_change_pct"]))
def _(spark, d):
    out = forecasts(spark, d).withColumn("signal", st.trading_signal())
    return out.select("symbol", "prediction_date", "signal", st.signal_action(F.col("signal")).alias("action"), "predicted_change_pct")


@register("recommendation_labels", statement(MADE, "forecasts", """symbol, prediction_date,
  CASE WHEN c > 3 AND k > 80 THEN 'Strong Buy' WHEN c > 1 AND k > 70 THEN 'Buy' WHEN c < -3 AND k > 80 THEN 'Strong Sell'
  WHEN c < -1 AND k > 70 THEN 'Sell' ELSE 'Hold' END AS recommendation""".replace(" c ", " predicted_change_pct * 5 ").replace(" k ", " (confidence + 10) ")))
def _(spark, d):
    scaled = forecasts(spark, d).select(
        "symbol", "prediction_date", (F.col("predicted_change_pct") * 5).alias("c"), (F.col("confidence") + 10).alias("k"))
    return scaled.select("symbol", "prediction_date", st.recommendation("c", "k").alias("recommendation"))


BOOK_SQL = """book AS (SELECT * FROM (VALUES ('aggressive', 1.0::DOUBLE, -1.0::DOUBLE, 60.0::DOUBLE, 0.3::DOUBLE, -5.0::DOUBLE, 10.0::DOUBLE),
  ('moderate', 0.5, -0.5, 70.0, 0.2, -3.0, 6.0), ('conservative', 2.0, -2.0, 80.0, 0.1, -2.0, 4.0))
  t(name, buy, sell, cmin, size, stop, take))"""
ACTION_SQL = "CASE WHEN predicted_change_pct > buy THEN 'BUY' WHEN predicted_change_pct < sell THEN 'SELL' ELSE 'HOLD' END"


def _recommend_sql(source, extra=()):
    return statement([MADE, BOOK_SQL, *extra], f"{source} JOIN book ON cmin <= confidence",
                     f"symbol, prediction_date, name AS strategy, {ACTION_SQL} AS action",
                     {"position_size": "size", "stop_loss": "stop", "take_profit": "take", "confidence": "confidence"})


@register("strategy_recommendations", _recommend_sql("forecasts"))
def _(spark, d):
    return st.recommend(forecasts(spark, d)).drop("reason")


ADJUST_SQL = """acc AS (SELECT avg(accuracy) AS a FROM scored),
adjusted AS (SELECT name, stop, take, true AS enabled,
  buy * CASE WHEN a < 60 THEN 1.2 WHEN a > 80 THEN 0.9 ELSE 1 END AS buy, sell * CASE WHEN a < 60 THEN 1.2 WHEN a > 80 THEN 0.9 ELSE 1 END AS sell,
  CASE WHEN a < 60 THEN least(90, cmin + 5) WHEN a > 80 THEN greatest(50, cmin - 5) ELSE cmin END AS cmin,
  CASE WHEN a < 60 THEN size * 0.8 WHEN a > 80 THEN least(0.5, size * 1.1) ELSE size END AS size FROM book, acc)"""
ADJUST_NUM = {"buy_threshold": "buy", "sell_threshold": "sell", "confidence_min": "cmin", "position_size": "size", "stop_loss": "stop", "take_profit": "take"}


@register("adjusted_strategies", statement([VALIDATION_CTES, BOOK_SQL, ADJUST_SQL], "adjusted", "name, enabled", ADJUST_NUM))
def _(spark, d):
    return st.adjust_strategies(scored(spark, d))


@register("validation_cycle", statement([VALIDATION_CTES, REPORT_SQL], "made JOIN rep USING (symbol)", REPORT_KEY, ["avg_accuracy", "best_accuracy", "worst_accuracy"]))
def _(spark, d):
    return cycles.validation_cycle(forecasts(spark, d), tame(spark, d))["report"]


@register("forecast_to_recommendation", _recommend_sql("newest", [NEWEST_CTE]))
def _(spark, d):
    return cycles.forecast_cycle(tame(spark, d))["recommendations"].drop("reason")
