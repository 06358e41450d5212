"""Back-tests."""

from pyspark.sql import functions as F

from barloom.operators import backtest as bt
from catalog.registry import SO_FAR, TAME, lag, layers, mean, pct, register, statement, tame

KEY = "symbol, date"
CROSS = [
    {"sma_50": mean("close", 50), "sma_200": mean("close", 200), "market_return": pct("close")},
    {"signal": "CASE WHEN sma_50 > sma_200 * (1 + 1e-12::DOUBLE) THEN 1 ELSE 0 END"},
    {"position": f"signal - {lag('signal')}", "held": lag("signal")},
    {"strategy_return": "market_return * held"},
    {"cum_market_return": f"CASE WHEN market_return IS NOT NULL THEN product(1 + market_return) OVER {SO_FAR} END",
     "cum_strategy_return": f"CASE WHEN strategy_return IS NOT NULL THEN product(1 + strategy_return) OVER {SO_FAR} END"},
]
CTES, LAST = layers("bars", *CROSS)


@register("ma_crossover", statement([TAME, *CTES], LAST, "symbol, date, signal, position", ["sma_50", "sma_200"]))
def _(spark, d):
    return bt.ma_crossover(tame(spark, d)).select("symbol", "date", "signal", "position", "sma_50", "sma_200")


RSI_CTES, RSI_LAST = layers(
    "bars", {"delta": f"close - {lag('close')}"},
    {"gain": "CASE WHEN delta > 0 THEN delta ELSE 0 END", "loss": "CASE WHEN delta < 0 THEN -delta ELSE 0 END"},
    {"g": mean("gain", 14), "l": mean("loss", 14)},
    {"rsi_14": "CASE WHEN l = 0 THEN CASE WHEN g > 0 THEN 100 END ELSE 100 - 100 / (1 + g / l) END"},
    {"signal": "CASE WHEN rsi_14 < 30 THEN 1 WHEN rsi_14 > 70 THEN -1 ELSE 0 END"}, {"position": f"signal - {lag('signal')}"},
)


@register("rsi_strategy", statement([TAME, *RSI_CTES], RSI_LAST, "symbol, date, signal, position", ["rsi_14"]))
def _(spark, d):
    return bt.rsi_strategy(tame(spark, d)).select("symbol", "date", "signal", "position", "rsi_14")


RETURNS = {c: c for c in ("market_return", "strategy_return", "cum_market_return", "cum_strategy_return")}


@register("strategy_returns", statement([TAME, *CTES], LAST, KEY, RETURNS | {"portfolio_value": "100000 * cum_strategy_return"}))
def _(spark, d):
    out = bt.strategy_returns(bt.ma_crossover(tame(spark, d)))
    return out.select("symbol", "date", *RETURNS, "portfolio_value")


@register("trade_events", statement([TAME, *CTES], LAST, "symbol, date, signal, position", ["close"], where="WHERE position IN (1, -1)"))
def _(spark, d):
    return bt.trade_events(bt.ma_crossover(tame(spark, d))).select("symbol", "date", "signal", "position", "close")


PEAK = f"peaks AS (SELECT *, max(cum_strategy_return) OVER {SO_FAR} AS peak FROM {LAST})"


def _metrics(capital):
    return f"""metrics AS (SELECT symbol, arg_max(cum_strategy_return * {capital}, date) AS final_value,
  (arg_max(cum_strategy_return, date) - 1) * 100 AS total_return_pct,
  sqrt(252) * avg(strategy_return) / nullif(stddev_samp(strategy_return), 0) AS sharpe_ratio,
  min((cum_strategy_return - peak) / peak) * 100 AS max_drawdown_pct,
  coalesce(count(*) FILTER (WHERE strategy_return > 0) * 100.0 / nullif(count(*) FILTER (WHERE strategy_return <> 0), 0), 0) AS win_rate_pct,
  count(*) FILTER (WHERE strategy_return <> 0) AS total_trades FROM peaks GROUP BY symbol)"""


@register("performance_metrics",
          statement([TAME, *CTES, PEAK, _metrics(100000)], "metrics", "symbol, CAST(100000 AS DOUBLE) AS initial_capital, total_trades",
                    ["final_value", "total_return_pct", "sharpe_ratio", "max_drawdown_pct", "win_rate_pct"]))
def _(spark, d):
    return bt.performance_metrics(bt.strategy_returns(bt.ma_crossover(tame(spark, d))))


@register("portfolio_summary",
          statement([TAME, *CTES, PEAK, _metrics(1)], "metrics", "count(*) AS symbols",
                    {"portfolio_return_pct": "avg(total_return_pct)", "avg_sharpe_ratio": "avg(sharpe_ratio)",
                     "avg_max_drawdown_pct": "avg(max_drawdown_pct)", "portfolio_value": "sum(final_value) * 100000 / count(*)"}))
def _(spark, d):
    return bt.portfolio_backtest(tame(spark, d))
