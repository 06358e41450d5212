"""Column-only forecasts, ensembles of forecasts and their error metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import clip
from barloom.functions.series import add_layers, last_rows, nxt, ratio, series, strip_temps
from barloom.operators.clean import newest_rows


def trend_forecast_rows(bars: DataFrame) -> DataFrame:
    """Moving-average trend forecast at every bar, from the rows up to that bar.

    Averages are taken over the rows there are (up to 20 and 50); with fewer than
    50 rows the longer average is the shorter one. A flat or single-row window has
    no volatility.
    """
    size50 = F.count("close").over(last_rows(50))
    ma20 = F.avg("close").over(last_rows(20))
    df = add_layers(
        bars,
        [
            {
                "__ma20": ma20,
                "__ma50": F.when(size50 == 50, F.avg("close").over(last_rows(50))).otherwise(ma20),
                "__vol": F.coalesce(F.stddev_samp("close").over(last_rows(20)), F.lit(0.0)),
            }
        ],
    )
    recent = ratio(F.col("close") - F.col("__ma20"), "__ma20") * 100
    long = F.when(
        F.col("__ma50") > 0, ratio(F.col("__ma20") - F.col("__ma50"), "__ma50") * 100
    ).otherwise(0.0)
    change = (recent * 0.6 + long * 0.4) * 0.3
    df = df.withColumns(
        {
            "current_price": F.col("close"),
            "predicted_change_pct": change,
            "predicted_price": F.col("close") * (1 + change / 100),
            "confidence": clip(70 - ratio("__vol", "close") * 100, 40.0, 90.0),
            "model_used": F.lit("Simple_MA_Trend"),
        }
    )
    return strip_temps(df)


FORECAST_COLUMNS = [
    "current_price", "predicted_price", "predicted_change_pct", "confidence", "model_used",
]


def trend_forecast(bars: DataFrame) -> DataFrame:
    """The forecast at the newest bar of every symbol, dated the next calendar day.

    Only the newest 50 rows matter, a limit Spark already applies before the shuffle.
    """
    rows = trend_forecast_rows(newest_rows(bars, 50))
    newest = rows.withColumn("__rn", F.row_number().over(series(newest_first=True))).filter("__rn = 1")
    return newest.select("symbol", F.date_add("date", 1).alias("prediction_date"), *FORECAST_COLUMNS)


def trend_forecast_history(bars: DataFrame) -> DataFrame:
    """The forecast made at every bar of every symbol, dated the next calendar day."""
    rows = trend_forecast_rows(bars)
    return rows.select(
        "symbol", F.col("date").alias("made_on"), F.date_add("date", 1).alias("prediction_date"),
        *FORECAST_COLUMNS,
    )


def meta_ensemble(forecasts: DataFrame) -> DataFrame:
    """Confidence-weighted mean of several models' forecasts per symbol and date."""
    weighted = F.sum(F.col("predicted_price") * F.col("confidence"))
    out = forecasts.groupBy("symbol", "prediction_date").agg(
        F.max("current_price").alias("current_price"),
        F.try_divide(weighted, F.sum("confidence")).alias("predicted_price"),
        F.avg("confidence").alias("confidence"),
        F.count(F.lit(1)).alias("models"),
    )
    change = ratio(F.col("predicted_price") - F.col("current_price"), "current_price") * 100
    return out.withColumns({"predicted_change_pct": change, "model_used": F.lit("ensemble_meta")})


def regression_metrics(df: DataFrame, actual="actual", predicted="predicted", by=()) -> DataFrame:
    """MSE, RMSE, MAE, R², MAPE, accuracy and direction agreement as plain aggregates."""
    a, p = F.col(actual), F.col(predicted)
    err = a - p
    sse, n = F.sum(err * err), F.count(err)
    mape = F.avg(F.abs(F.try_divide(err, a))) * 100
    return df.groupBy(*by).agg(
        n.alias("n"),
        (sse / n).alias("mse"),
        F.sqrt(sse / n).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        (1 - F.try_divide(sse, F.var_pop(a) * n)).alias("r2"),
        mape.alias("mape"),
        F.greatest(F.lit(0.0), 100 - mape).alias("accuracy"),
        (F.avg(((p > 0) == (a > 0)).cast("int")) * 100).alias("direction_accuracy"),
    )


def best_model(metrics: DataFrame, score="accuracy", by=()) -> DataFrame:
    """The best-scoring model (ties: the alphabetically last) with its score."""
    pick = F.max(F.struct(F.col(score).alias("score"), F.col("model").alias("model")))
    best = metrics.groupBy(*by).agg(pick.alias("b"), F.count(F.lit(1)).alias("models"))
    return best.select(
        *by, F.col("b.model").alias("best_model"), F.col("b.score").alias("best_score"), "models"
    )


def model_report(metrics: DataFrame, score="accuracy") -> DataFrame:
    """Every model with its score as a fraction and in percent, the weight it would get."""
    total = metrics.agg(F.sum(score)).scalar()
    return metrics.select(
        "model", (F.col(score) / 100).alias("score"), F.col(score).alias("accuracy_pct"),
        F.try_divide(F.col(score), total).alias("weight"),
    )


def trend_lines(bars: DataFrame) -> DataFrame:
    """Least-squares line of the next close on the close, per symbol."""
    df = bars.withColumn("target", nxt("close")).filter(F.col("target").isNotNull())
    return df.groupBy("symbol").agg(
        F.regr_slope("target", "close").alias("slope"),
        F.regr_intercept("target", "close").alias("intercept"),
        F.regr_count("target", "close").alias("n"),
    )
