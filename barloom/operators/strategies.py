"""Signals, recommendations and the self-adjusting strategy book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.scalars import ladder
from barloom.schema import STRATEGIES

# The default strategy book.
DEFAULT_STRATEGIES = [
    {"name": "aggressive", "buy_threshold": 1.0, "sell_threshold": -1.0, "confidence_min": 60.0,
     "position_size": 0.3, "stop_loss": -5.0, "take_profit": 10.0, "enabled": True},
    {"name": "moderate", "buy_threshold": 0.5, "sell_threshold": -0.5, "confidence_min": 70.0,
     "position_size": 0.2, "stop_loss": -3.0, "take_profit": 6.0, "enabled": True},
    {"name": "conservative", "buy_threshold": 2.0, "sell_threshold": -2.0, "confidence_min": 80.0,
     "position_size": 0.1, "stop_loss": -2.0, "take_profit": 4.0, "enabled": True},
]
# A strategy book is a configuration file; more entries than this are an input error.
MAX_STRATEGIES = 1000


def default_strategies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT_STRATEGIES, STRATEGIES)


def strategy_book(strategies) -> list[dict]:
    """The book as plain rows; a DataFrame is read with its size checked."""
    if isinstance(strategies, DataFrame):
        strategies = [r.asDict() for r in strategies.limit(MAX_STRATEGIES + 1).collect()]
    if len(strategies) > MAX_STRATEGIES:
        raise ValueError(f"a strategy book holds at most {MAX_STRATEGIES} strategies")
    return list(strategies)


def _book_column(book: list[dict]) -> Column:
    entries = [
        F.struct(*[F.lit(s[f.name]).cast(f.dataType).alias(f.name) for f in STRATEGIES]) for s in book
    ]
    return F.array(*entries)


def trading_signal(change="predicted_change_pct", confidence="confidence") -> Column:
    c, k = F.col(change), F.col(confidence)
    return ladder(
        [
            ((c > 2) & (k > 70), "STRONG BUY"), ((c > 0.5) & (k > 60), "BUY"),
            ((c < -2) & (k > 70), "STRONG SELL"), ((c < -0.5) & (k > 60), "SELL"),
        ],
        "HOLD",
    )


# The action text of each signal.
SIGNAL_ACTIONS = {
    "STRONG BUY": "Buy aggressively", "BUY": "Consider buying",
    "STRONG SELL": "Sell immediately", "SELL": "Consider selling", "HOLD": "Hold position",
}


def signal_action(signal: Column) -> Column:
    return ladder([(signal == s, text) for s, text in SIGNAL_ACTIONS.items()], "Hold position")


def recommendation(change="predicted_change_pct", confidence="confidence") -> Column:
    c, k = F.col(change), F.col(confidence)
    return ladder(
        [
            ((c > 3) & (k > 80), "Strong Buy"), ((c > 1) & (k > 70), "Buy"),
            ((c < -3) & (k > 80), "Strong Sell"), ((c < -1) & (k > 70), "Sell"),
        ],
        "Hold",
    )


def recommend(predictions: DataFrame, strategies=DEFAULT_STRATEGIES) -> DataFrame:
    """BUY/SELL/HOLD of every enabled strategy whose minimum confidence a forecast meets.

    The book travels with the plan as a literal array that is filtered before it is
    exploded, so the predictions are neither shuffled nor joined.
    """
    book = [s for s in strategy_book(strategies) if s["enabled"]]
    if not book:
        raise ValueError("no enabled strategy")
    fitting = F.filter(_book_column(book), lambda s: s["confidence_min"] <= F.col("confidence"))
    df = predictions.withColumn("s", F.explode(fitting))
    change, buy, sell = F.col("predicted_change_pct"), F.col("s.buy_threshold"), F.col("s.sell_threshold")
    action = ladder([(change > buy, "BUY"), (change < sell, "SELL")], "HOLD")
    text = F.format_string("%.2f", change)
    reason = (
        F.when(change > buy, F.concat(F.lit("Predicted +"), text, F.lit("% > threshold "),
                                      F.format_string("%.2f", buy), F.lit("%")))
        .when(change < sell, F.concat(F.lit("Predicted "), text, F.lit("% < threshold "),
                                      F.format_string("%.2f", sell), F.lit("%")))
        .otherwise(F.concat(F.lit("Change "), text, F.lit("% within hold range")))
    )
    return df.select(
        "symbol", "prediction_date", F.col("s.name").alias("strategy"), action.alias("action"),
        reason.alias("reason"), F.col("s.position_size").alias("position_size"),
        F.col("s.stop_loss").alias("stop_loss"), F.col("s.take_profit").alias("take_profit"),
        "confidence",
    )


def adjust_strategies(validations: DataFrame, strategies=DEFAULT_STRATEGIES) -> DataFrame:
    """The book after one adjustment by the mean accuracy of the validations.

    Below 60 the enabled strategies become more careful, above 80 bolder; without
    validations nothing changes.
    """
    mean = validations.agg(F.avg("accuracy").alias("avg_accuracy"))
    df = mean.select("avg_accuracy", F.explode(_book_column(strategy_book(strategies))).alias("s"))
    poor = F.col("s.enabled") & (F.col("avg_accuracy") < 60)
    good = F.col("s.enabled") & (F.col("avg_accuracy") > 80)

    def changed(name, when_poor, when_good):
        c = F.col(f"s.{name}")
        return F.when(poor, when_poor(c)).when(good, when_good(c)).otherwise(c).alias(name)

    return df.select(
        F.col("s.name").alias("name"),
        changed("buy_threshold", lambda c: c * 1.2, lambda c: c * 0.9),
        changed("sell_threshold", lambda c: c * 1.2, lambda c: c * 0.9),
        changed("confidence_min", lambda c: F.least(F.lit(90.0), c + 5),
                lambda c: F.greatest(F.lit(50.0), c - 5)),
        changed("position_size", lambda c: c * 0.8, lambda c: F.least(F.lit(0.5), c * 1.1)),
        F.col("s.stop_loss").alias("stop_loss"), F.col("s.take_profit").alias("take_profit"),
        F.col("s.enabled").alias("enabled"),
    )
