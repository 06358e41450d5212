"""Headline queries, timed one after the other; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and
cores. Every query reads the given tables from Parquet and computes all of its columns.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barloom.session import local_session  # noqa: E402
from catalog.registry import UNROUNDED  # noqa: E402
import catalog  # noqa: E402, F401

HEADLINE = [
    "daily_bars", "market_screen", "market_screen_page", "criteria_filter", "summary_card", "table_stats", "clean_bars",
    "simple_moving_averages", "exponential_moving_averages", "rsi", "macd", "bollinger_bands", "features_ensemble",
    "features_basic", "features_universal", "performance_metrics", "trend_forecast", "scored_forecasts_next_bar",
    "accuracy_cube", "strategy_recommendations", "pending_bars", "streamed_average", "model_per_symbol",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    known = UNROUNDED
    known["symbol_list"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
