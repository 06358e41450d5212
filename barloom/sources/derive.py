"""Daily bars derived from trade-like line items.

The only wide step is the aggregation to the (symbol, date) grain. It combines
on the map side, so a symbol that owns a large share of the raw rows reaches the
shuffle as at most one partial row per day and task.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHIFT = Decimal(2**63 - 1)


def two_longs(high: Column, low: Column) -> Column:
    """One decimal that orders like the pair (high, low) of non-negative longs.

    A decimal is a fixed-width aggregation buffer, so min_by/max_by over it run as
    hash aggregates; a struct key would make both sides of the shuffle sort first.
    """
    return (high.cast("decimal(19,0)") * F.lit(SHIFT) + low.cast("decimal(19,0)")).cast("decimal(38,0)")


def trade_order() -> Column:
    """Total order (order, line, part, price) of the line items of one symbol and day."""
    order_line = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return two_longs(order_line, F.col("l_partkey") * F.lit(2**28) + cents)


def unit_price() -> Column:
    return F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))


def tame_price() -> Column:
    return 100 * (1 + F.col("l_discount")) + F.col("l_quantity") / 50


def trades(lineitem: DataFrame, tame: bool = False) -> DataFrame:
    """One row per line item as (symbol, date, seq, price, volume), before any grouping."""
    price = tame_price() if tame else unit_price()
    return lineitem.select(
        F.col("l_suppkey").alias("symbol"),
        F.to_date("l_shipdate").alias("date"),
        trade_order().alias("seq"),
        price.alias("price"),
        F.col("l_quantity").alias("volume"),
    )


def bars_from_trades(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy("symbol", "date").agg(
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.sum("volume").cast("long").alias("volume"),
    )


def derive_bars(lineitem: DataFrame, tame: bool = False) -> DataFrame:
    return bars_from_trades(trades(lineitem, tame))


def event_order() -> Column:
    return two_longs(F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id"))


def bars_from_events(events: DataFrame) -> DataFrame:
    """Daily bars of an event stream: symbol = event type, price = value."""
    return bars_from_trades(
        events.select(
            F.col("event_type").alias("symbol"),
            F.to_date("ts").alias("date"),
            event_order().alias("seq"),
            F.col("value").alias("price"),
            F.lit(1).alias("volume"),
        )
    )
