"""Scoring forecasts against what happened, and the accuracy reports built on the scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import ladder
from barloom.functions.series import correlation, nxt, ratio
from barloom.operators.grain import latest_date, latest_per_key

# Metrics a ranking may use.
RANK_METRICS = ("accuracy_score", "price_error_pct", "confidence", "actual_change_pct")


# --- matching forecasts to actual closes ---------------------------------------------

def match_exact(predictions: DataFrame, bars: DataFrame, on="prediction_date") -> DataFrame:
    """Forecasts with the close of exactly their date; others are left out."""
    actual = bars.select("symbol", F.col("date").alias(on), F.col("close").alias("actual_price"))
    matched = predictions.join(actual, ["symbol", on])
    return matched.withColumn("validation_date", F.col(on))


def match_next_day(predictions: DataFrame, bars: DataFrame) -> DataFrame:
    """Forecasts stamped with the day they were made, against the following calendar day."""
    shifted = predictions.withColumn("validation_date", F.date_add("made_on", 1))
    actual = bars.select(
        "symbol", F.col("date").alias("validation_date"), F.col("close").alias("actual_price")
    )
    return shifted.join(actual, ["symbol", "validation_date"])


def match_next_bar(predictions: DataFrame, bars: DataFrame) -> DataFrame:
    """Forecasts made at a bar against the first bar after it, however far away.

    The next bar is looked up once with ``lead`` on the bars, so the as-of match is a
    plain equi-join on (symbol, day).
    """
    following = bars.select(
        "symbol", F.col("date").alias("made_on"),
        nxt("date").alias("validation_date"), nxt("close").alias("actual_price"),
    ).filter(F.col("validation_date").isNotNull())
    return predictions.join(following, ["symbol", "made_on"])


def match_asof(predictions: DataFrame, bars: DataFrame) -> DataFrame:
    """Forecasts of any date against the first bar strictly after ``made_on``.

    Both sides are merged into one date-ordered stream per symbol and the next close
    is carried back over it (newest first, a growing frame), so nothing is paired that does not match. Unlike
    ``match_next_bar`` the forecasts need not fall on a bar.
    """
    quotes = bars.select(
        "symbol", F.col("date").alias("at"), F.lit(0).alias("is_forecast"),
        F.struct("date", "close").alias("quote"), F.lit(None).cast(predictions_struct(predictions)).alias("p"),
    )
    asks = predictions.select(
        "symbol", F.col("made_on").alias("at"), F.lit(1).alias("is_forecast"),
        F.lit(None).cast(quotes.schema["quote"].dataType).alias("quote"),
        F.struct(*[c for c in predictions.columns if c != "symbol"]).alias("p"),
    )
    later = (
        Window.partitionBy("symbol").orderBy(F.desc("at"), F.desc("is_forecast"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = quotes.unionByName(asks).withColumn("q", F.last("quote", ignorenulls=True).over(later))
    hit = joined.filter((F.col("is_forecast") == 1) & F.col("q").isNotNull())
    return hit.select(
        "symbol", *[F.col(f"p.{c}").alias(c) for c in predictions.columns if c != "symbol"],
        F.col("q.date").alias("validation_date"), F.col("q.close").alias("actual_price"),
    )


def predictions_struct(predictions: DataFrame):
    """Type of the forecast columns other than the symbol, as one struct."""
    return predictions.select(
        F.struct(*[c for c in predictions.columns if c != "symbol"]).alias("p")
    ).schema["p"].dataType


# --- scoring ----------------------------------------------------------------------------

def score(matched: DataFrame) -> DataFrame:
    """Price error, direction agreement, accuracy and status of matched forecasts."""
    error = F.abs(F.col("predicted_price") - F.col("actual_price"))
    error_pct = ratio(error, "actual_price") * 100
    moved = ratio(F.col("actual_price") - F.col("current_price"), "current_price") * 100
    return matched.withColumns(
        {"price_error": error, "price_error_pct": error_pct, "actual_change_pct": moved}
    ).withColumns(
        {
            "direction_correct": (F.col("predicted_change_pct") > 0) == (F.col("actual_change_pct") > 0),
            "accuracy_score": F.greatest(F.lit(0.0), 100 - F.col("price_error_pct")),
            "accuracy": 100 - F.col("price_error_pct"),
            "status": status(F.col("price_error_pct")),
        }
    )


def status(error_pct: Column) -> Column:
    return ladder([(error_pct < 5, "accurate"), (error_pct < 10, "moderate")], "poor")


def score_forecasts(predictions: DataFrame, bars: DataFrame, match="next_bar") -> DataFrame:
    matchers = {
        "exact": match_exact, "next_day": match_next_day,
        "next_bar": match_next_bar, "asof": match_asof,
    }
    return score(matchers[match](predictions, bars))


# --- reports -----------------------------------------------------------------------------

def recent(validations: DataFrame, as_of=None, days=30) -> DataFrame:
    anchor = latest_date(validations, "validation_date") if as_of is None else as_of
    return validations.filter(F.col("validation_date") >= F.date_sub(anchor, days))


def history(validations: DataFrame, symbol=None, model=None, as_of=None, days=30) -> DataFrame:
    """Validations of the last days, optionally of one symbol or model, newest first."""
    out = recent(validations, as_of, days)
    if symbol is not None:
        out = out.filter(F.col("symbol") == F.lit(symbol))
    if model is not None:
        out = out.filter(F.col("model_used") == F.lit(model))
    return out.orderBy(F.desc("validation_date"), "symbol")


def _hit_pct() -> Column:
    return F.avg(F.when(F.col("direction_correct"), 100).otherwise(0))


def model_performance(validations: DataFrame, as_of=None, days=30) -> DataFrame:
    return recent(validations, as_of, days).groupBy("model_used").agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.avg("accuracy_score").alias("avg_accuracy"),
        _hit_pct().alias("direction_accuracy"),
        F.avg("price_error_pct").alias("avg_error_pct"),
        F.avg("confidence").alias("avg_confidence"),
        F.min("validation_date").alias("first_prediction"),
        F.max("validation_date").alias("last_prediction"),
    )


def top_symbols(validations: DataFrame, limit=10, metric="accuracy_score", as_of=None, days=30):
    """Symbols with at least three validations, best mean metric first."""
    if metric not in RANK_METRICS:
        raise ValueError(f"metric must be one of {RANK_METRICS}")
    out = recent(validations, as_of, days).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("prediction_count"),
        F.avg(metric).alias("avg_metric"),
        _hit_pct().alias("direction_accuracy"),
        F.avg("confidence").alias("avg_confidence"),
        F.max("validation_date").alias("last_validation"),
    )
    return out.filter(F.col("prediction_count") >= 3).orderBy(F.desc("avg_metric"), "symbol").limit(limit)


def daily_trend(validations: DataFrame, as_of=None, days=30, by_model=False) -> DataFrame:
    keys = (["model_used"] if by_model else []) + ["validation_date"]
    return recent(validations, as_of, days).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("prediction_count"),
        F.avg("accuracy_score").alias("avg_accuracy"),
        _hit_pct().alias("direction_accuracy"),
        F.avg("confidence").alias("avg_confidence"),
    )


def accuracy_cube(validations: DataFrame, as_of=None, days=30) -> DataFrame:
    """The per-model, per-day, per-model-and-day and overall reports in one pass."""
    rows = recent(validations, as_of, days)
    sets = [[F.col("model_used"), F.col("validation_date")], [F.col("model_used")],
            [F.col("validation_date")], []]
    return rows.groupingSets(sets, "model_used", "validation_date").agg(
        F.grouping_id().cast("int").alias("level"),
        F.count(F.lit(1)).alias("prediction_count"),
        F.avg("accuracy_score").alias("avg_accuracy"),
        _hit_pct().alias("direction_accuracy"),
        F.avg("price_error_pct").alias("avg_error_pct"),
        F.avg("confidence").alias("avg_confidence"),
    )


def run_summary(validations: DataFrame) -> DataFrame:
    def mean_or_0(c):
        return F.coalesce(F.avg(c), F.lit(0.0))

    return validations.agg(
        F.count(F.lit(1)).alias("total_validated"),
        mean_or_0("accuracy_score").alias("average_accuracy"),
        F.coalesce(_hit_pct(), F.lit(0.0)).alias("direction_accuracy"),
        mean_or_0("price_error_pct").alias("average_price_error_pct"),
    )


def model_comparison(latest_predictions: DataFrame) -> DataFrame:
    """Per model: how many newest forecasts, their mean confidence and change."""
    return latest_predictions.groupBy("model_used").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("confidence").alias("avg_confidence"),
        F.avg("predicted_change_pct").alias("avg_predicted_change"),
    )


def model_symbols(latest_predictions: DataFrame) -> DataFrame:
    """The symbols behind each model, one per row: a list per model would not be bounded."""
    return latest_predictions.select("model_used", "symbol").distinct()


def hit_rates(predictions: DataFrame, validations: DataFrame, tolerance=5.0) -> DataFrame:
    """Per model: share of scored forecasts within the tolerance and their mean error."""
    scored = validations.join(
        predictions.select("symbol", F.col("prediction_date").alias("validation_date")),
        ["symbol", "validation_date"],
    )
    gap = F.abs(F.col("predicted_change_pct") - F.col("actual_change_pct"))
    return scored.groupBy("model_used").agg(
        (F.avg(F.when(gap < tolerance, 1).otherwise(0)) * 100).alias("accuracy_rate"),
        F.avg(gap).alias("avg_error"),
        F.count(F.lit(1)).alias("validation_count"),
    )


def mean_hit_rate(rates: DataFrame) -> DataFrame:
    return rates.agg(F.coalesce(F.avg("accuracy_rate"), F.lit(0.0)).alias("avg_accuracy"))


def mean_symbol_accuracy(validations: DataFrame) -> DataFrame:
    per_symbol = validations.groupBy("symbol").agg(F.avg("accuracy_score").alias("a"))
    return per_symbol.agg(F.coalesce(F.avg("a"), F.lit(0.0)).alias("average_accuracy"))


def predictions_vs_actuals(validations: DataFrame, model=None, as_of=None, days=30) -> DataFrame:
    """Correlation, R² and accuracy spread of predicted against actual prices."""
    rows = recent(validations, as_of, days)
    if model is not None:
        rows = rows.filter(F.col("model_used") == F.lit(model))
    a, p = F.col("actual_price"), F.col("predicted_price")
    n = F.count(F.lit(1))
    return rows.agg(
        F.coalesce(correlation(p, a), F.lit(0.0)).alias("correlation"),
        (1 - F.try_divide(F.sum((a - p) * (a - p)), F.var_pop(a) * n)).alias("r2_score"),
        n.alias("total_predictions"),
        F.avg("accuracy_score").alias("mean_accuracy"),
        F.stddev_samp("accuracy_score").alias("std_accuracy"),
    )


def symbol_report(predictions: DataFrame, validations: DataFrame) -> DataFrame:
    """Per symbol: forecasts, how many were scored, accuracy range, counts per status."""
    made = predictions.groupBy("symbol").agg(F.count(F.lit(1)).alias("total_predictions"))
    st = F.col("status")
    scored = validations.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("validated_predictions"),
        F.avg("accuracy").alias("avg_accuracy"),
        F.max("accuracy").alias("best_accuracy"),
        F.min("accuracy").alias("worst_accuracy"),
        F.count_if(st == "accurate").alias("accurate_count"),
        F.count_if(st == "moderate").alias("moderate_count"),
        F.count_if(st == "poor").alias("poor_count"),
    )
    return made.join(scored, "symbol")


def prediction_stats(latest_predictions: DataFrame) -> DataFrame:
    per_symbol = latest_predictions.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.max("prediction_date").alias("d")
    )
    return per_symbol.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_predictions"),
        F.count(F.lit(1)).alias("unique_stocks"),
        F.max("d").alias("latest_prediction_date"),
    )


def predictions_on(predictions: DataFrame, date=None) -> DataFrame:
    """All forecasts for one date, or the newest forecast of every symbol."""
    if date is None:
        return latest_per_key(predictions)
    return predictions.filter(F.col("prediction_date") == F.lit(date).cast("date"))


def latest_by_semi_join(predictions: DataFrame) -> DataFrame:
    """Newest forecasts by the aggregate-and-semi-join form; keeps ties."""
    newest = predictions.groupBy("symbol").agg(F.max("prediction_date").alias("prediction_date"))
    return predictions.join(newest, ["symbol", "prediction_date"], "left_semi")


def prediction_for(predictions: DataFrame, symbol) -> DataFrame:
    mine = predictions.filter(F.col("symbol") == F.lit(symbol))
    return mine.orderBy(F.desc("prediction_date")).limit(1)
