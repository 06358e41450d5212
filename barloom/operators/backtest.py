"""Rule-based back-tests over all symbols at once."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.series import add_layers, indicator, pct_change, prev, ratio, so_far, strip_temps
from barloom.operators import indicators as ind


# Relative distance below which two averages count as equal.
TIE = 1e-12


def _with_position(df: DataFrame) -> DataFrame:
    return df.withColumn("position", F.col("signal") - prev("signal"))


def ma_crossover(bars: DataFrame, short=50, long=200) -> DataFrame:
    """Long while the short average is above the long one; ``position`` marks the changes.

    Averages that agree to 12 digits are a tie, which is no crossover: otherwise the
    order of additions would decide.
    """
    df = indicator(bars, ind.sma_recipe((short, long)))
    above = F.col(f"sma_{short}") > F.col(f"sma_{long}") * (1 + TIE)
    return _with_position(df.withColumn("signal", F.when(above, 1).otherwise(0)))


def rsi_strategy(bars: DataFrame, n=14, low=30, high=70) -> DataFrame:
    """Buy below the lower RSI bound, sell above the upper one, else stay out."""
    df = indicator(bars, ind.rsi_recipe((n,)))
    rsi = F.col(f"rsi_{n}")
    return _with_position(
        df.withColumn("signal", F.when(rsi < low, 1).when(rsi > high, -1).otherwise(0))
    )


def strategy_returns(signals: DataFrame, capital=100000.0) -> DataFrame:
    """Market and strategy returns with their cumulative growth and portfolio value."""
    df = signals.withColumns({"market_return": pct_change("close"), "__held": prev("signal")})
    df = df.withColumn("strategy_return", F.col("market_return") * F.col("__held"))
    def grown(c):
        return F.when(F.col(c).isNotNull(), F.product(1 + F.col(c)).over(so_far()))
    df = df.withColumns(
        {"cum_market_return": grown("market_return"), "cum_strategy_return": grown("strategy_return")}
    )
    return strip_temps(df.withColumn("portfolio_value", capital * F.col("cum_strategy_return")))


def trade_events(signals: DataFrame) -> DataFrame:
    return signals.filter(F.abs("position") >= 1)


def performance_metrics(returns: DataFrame, capital=100000.0) -> DataFrame:
    """Final value, total return, Sharpe ratio, drawdown, win rate and trades per symbol.

    Only rows with a non-null, non-zero strategy return count as trades.
    """
    df = add_layers(returns, [{"__peak": F.max("cum_strategy_return").over(so_far())}])
    drawdown = ratio(F.col("cum_strategy_return") - F.col("__peak"), "__peak")
    r = F.col("strategy_return")
    wins, trades = F.count_if(r > 0), F.count_if(r != 0)
    final = F.max_by("portfolio_value", "date")
    return df.groupBy("symbol").agg(
        F.lit(float(capital)).alias("initial_capital"),
        final.alias("final_value"),
        ((final - capital) / capital * 100).alias("total_return_pct"),
        (math.sqrt(252) * F.try_divide(F.avg(r), F.stddev_samp(r))).alias("sharpe_ratio"),
        (F.min(drawdown) * 100).alias("max_drawdown_pct"),
        F.coalesce(F.try_divide(wins * 100.0, trades), F.lit(0.0)).alias("win_rate_pct"),
        trades.alias("total_trades"),
    )


def portfolio_summary(metrics: DataFrame) -> DataFrame:
    """Means over the symbols of an equally weighted portfolio."""
    return metrics.agg(
        F.count(F.lit(1)).alias("symbols"),
        F.avg("total_return_pct").alias("portfolio_return_pct"),
        F.avg("sharpe_ratio").alias("avg_sharpe_ratio"),
        F.avg("max_drawdown_pct").alias("avg_max_drawdown_pct"),
        F.sum("final_value").alias("portfolio_value"),
    )


def portfolio_backtest(bars: DataFrame, capital=100000.0, short=50, long=200) -> DataFrame:
    """Capital split evenly over all symbols, moving-average crossover on each."""
    signals = ma_crossover(bars, short, long)
    per_unit = performance_metrics(strategy_returns(signals, 1.0), 1.0)
    summed = portfolio_summary(per_unit)
    share = F.lit(float(capital)) / F.col("symbols")
    return summed.withColumn("portfolio_value", F.col("portfolio_value") * share)
