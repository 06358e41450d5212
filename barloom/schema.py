"""Explicit table schemas; nothing in the engine infers a schema."""

from pyspark.sql.types import (
    BooleanType,
    DateType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(*fields):
    return StructType([StructField(name, dtype, True) for name, dtype in fields])


PRICE_COLUMNS = ["open", "high", "low", "close"]
BAR_COLUMNS = ["symbol", "date", *PRICE_COLUMNS, "volume"]

BARS = _struct(
    ("symbol", StringType()),
    ("date", DateType()),
    ("open", DoubleType()),
    ("high", DoubleType()),
    ("low", DoubleType()),
    ("close", DoubleType()),
    ("volume", LongType()),
)

SYMBOL_STATS = _struct(
    ("symbol", StringType()),
    ("last_sync", TimestampType()),
    ("record_count", LongType()),
    ("last_date", DateType()),
    ("last_close", DoubleType()),
)

PREDICTIONS = _struct(
    ("symbol", StringType()),
    ("prediction_date", DateType()),
    ("current_price", DoubleType()),
    ("predicted_price", DoubleType()),
    ("predicted_change_pct", DoubleType()),
    ("confidence", DoubleType()),
    ("model_used", StringType()),
)

VALIDATIONS = _struct(
    ("symbol", StringType()),
    ("validation_date", DateType()),
    ("predicted_price", DoubleType()),
    ("actual_price", DoubleType()),
    ("predicted_change_pct", DoubleType()),
    ("actual_change_pct", DoubleType()),
    ("price_error", DoubleType()),
    ("price_error_pct", DoubleType()),
    ("direction_correct", BooleanType()),
    ("confidence", DoubleType()),
    ("model_used", StringType()),
    ("accuracy_score", DoubleType()),
)

STRATEGIES = _struct(
    ("name", StringType()),
    ("buy_threshold", DoubleType()),
    ("sell_threshold", DoubleType()),
    ("confidence_min", DoubleType()),
    ("position_size", DoubleType()),
    ("stop_loss", DoubleType()),
    ("take_profit", DoubleType()),
    ("enabled", BooleanType()),
)
