"""Readers for bar CSV drops, forecast-history JSON, strategy JSON and symbol masters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.clean import min_history
from barloom.operators.grain import dedupe
from barloom.operators.strategies import DEFAULT_STRATEGIES
from barloom.schema import STRATEGIES
from barloom.sources.bar_csv import scan


def read_bar_files(spark: SparkSession, path: str) -> DataFrame:
    """One CSV per symbol, in any known header layout, as typed bars plus ``seq``, the place in the file.

    ``bar_csv.scan`` also gives the lines and files that were not taken.
    """
    return scan(spark, path).bars


def read_bars_csv(spark: SparkSession, path: str, min_rows=None, keep="last") -> DataFrame:
    """Bars of a CSV folder at the one-row-per-(symbol, date) grain."""
    bars = dedupe(read_bar_files(spark, path), seq="seq", keep=keep)
    return bars if min_rows is None else min_history(bars, min_rows)


def read_symbol_master(spark: SparkSession, path: str, column="SYMBOL") -> DataFrame:
    rows = spark.read.option("header", True).csv(path)
    return rows.select(F.trim(F.col(column)).alias("symbol")).filter("symbol <> ''").distinct()


HISTORY_TYPE = (
    "map<string, map<string, struct<predicted_price: double, current_price: double, "
    "predicted_change: double, confidence: double, model: string, timestamp: string, "
    "validated: boolean, validation: struct<date: string, predicted_price: double, "
    "actual_price: double, error: double, error_pct: double, accuracy: double, "
    "status: string, validated_at: string>>>>"
)


def read_forecast_history(spark: SparkSession, path: str, one_document_per_file=True) -> DataFrame:
    """Nested ``{symbol: {date: forecast}}`` documents as one row per forecast.

    Histories kept as JSON lines (``one_document_per_file=False``) are split over tasks.
    """
    text = spark.read.text(path, wholetext=one_document_per_file)
    symbols = text.select(F.explode(F.from_json("value", HISTORY_TYPE)).alias("symbol", "by_date"))
    rows = symbols.select("symbol", F.explode("by_date").alias("day", "f"))
    return rows.select(
        "symbol", F.to_date("day").alias("made_on"),
        F.date_add(F.to_date("day"), 1).alias("prediction_date"),
        F.col("f.current_price").alias("current_price"),
        F.col("f.predicted_price").alias("predicted_price"),
        F.col("f.predicted_change").alias("predicted_change_pct"),
        F.col("f.confidence").alias("confidence"), F.col("f.model").alias("model_used"),
        F.coalesce("f.validated", F.lit(False)).alias("validated"),
        F.col("f.validation").alias("validation"),
    )


STRATEGY_TYPE = (
    "map<string, struct<buy_threshold: double, sell_threshold: double, confidence_min: double, "
    "position_size: double, stop_loss: double, take_profit: double, enabled: boolean>>"
)


def read_strategies(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The strategy book of a JSON file, the default book without one."""
    if path is None:
        return spark.createDataFrame(DEFAULT_STRATEGIES, STRATEGIES)
    book = spark.read.text(path, wholetext=True).select(
        F.explode(F.from_json("value", STRATEGY_TYPE)).alias("name", "s")
    )
    return book.select("name", "s.*")


def write_strategies(strategies: DataFrame, path: str) -> None:
    """One JSON document ``{name: settings}``; a book is a configuration file of bounded size."""
    from barloom.operators.strategies import strategy_book

    book = strategy_book(strategies)
    spark = strategies.sparkSession
    fields = [f.name for f in STRATEGIES if f.name != "name"]
    rows = spark.createDataFrame(book, STRATEGIES)
    entry = F.struct("name", F.struct(*fields).alias("settings"))
    document = rows.agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    document.write.mode("overwrite").text(path)
