"""Edge series and invariants."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions.series import indicator
from barloom.operators import backtest as bt
from barloom.operators import clean
from barloom.operators import forecast as fc
from barloom.operators import indicators as ind
from barloom.operators import screens as sc
from barloom.operators import strategies as st
from barloom.operators import validation as val
from barloom.operators.grain import dedupe
from barloom.plans import features as bundles


def values(df, name):
    return [r[name] for r in df.orderBy("symbol", "date").collect()]


def test_rsi_edges(make_bars):
    df = ind.rsi(make_bars({"flat": [5.0] * 20, "up": range(1, 21)}), 14).orderBy("symbol", "date")
    flat = [r["rsi_14"] for r in df.filter("symbol = 'flat'").collect()]
    up = [r["rsi_14"] for r in df.filter("symbol = 'up'").collect()]
    assert flat == [None] * 20
    assert up == [None] * 13 + [100.0] * 7


def test_short_series_have_no_window_values(make_bars):
    df = ind.bollinger(make_bars({"A": range(1, 20), "B": [3.0]}), 20)
    assert all(v is None for v in values(df, "bb_middle_20"))


def test_zero_volume_run(make_bars):
    rows = [("A", dt.date(2020, 1, 1) + dt.timedelta(days=i), 1.0, 2.0, 0.5, 1.0 + i % 3, 0) for i in range(30)]
    df = indicator(make_bars(rows=rows), ind.mfi_recipe((14,)), ind.volume_recipe(20), ind.vwap_recipe())
    assert set(values(df, "mfi_14")) == {None}
    assert set(values(df, "volume_ratio")) == {None}
    assert set(values(df, "vwap")) == {None}


def test_fill_gaps_at_start_middle_end(make_bars, spark):
    rows = [("A", dt.date(2020, 1, i + 1), v) for i, v in enumerate([None, 2.0, None, None, 5.0, None])]
    df = spark.createDataFrame(rows, "symbol string, date date, close double")
    assert values(clean.forward_backward_fill(df, ["close"]), "close") == [2.0, 2.0, 2.0, 2.0, 5.0, 5.0]


def test_impossible_rows_and_outliers_drop(make_bars):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(13)]
    rows = [("A", d, 10.0, 11.0, 9.0, 10.0 + i * 0.1, 5) for i, d in enumerate(days[:10])]
    rows += [("A", days[10], 10.0, 8.0, 9.0, 10.0, 5), ("A", days[11], 10.0, 11.0, 0.0, 10.0, 5),
             ("A", days[12], 1000.0, 1100.0, 900.0, 1000.0, 5)]
    assert clean.clean_bars(make_bars(rows=rows)).count() == 10


def test_dedupe_first_and_last(spark):
    df = spark.createDataFrame([("A", 1, 3, "c"), ("A", 1, 1, "a"), ("A", 1, 2, "b"), ("B", 1, 9, "z")],
                               "symbol string, date int, seq int, v string")
    assert {r["v"] for r in dedupe(df, keep="first").collect()} == {"a", "z"}
    assert {r["v"] for r in dedupe(df, keep="last").collect()} == {"c", "z"}


def test_features_do_not_look_ahead_or_across(make_bars):
    rng = np.random.default_rng(3)
    a, b = (list(100 + np.cumsum(rng.normal(0, 1, 260))) for _ in range(2))
    targets = ("target", "target_return", "target_price")
    for bundle in (bundles.features_basic, bundles.features_trend, bundles.features_universal):
        def table(series):
            df = bundle(make_bars(series))
            return df.drop(*targets).filter("symbol = 'A'").orderBy("date").toPandas()

        alone, together, cut = table({"A": a}), table({"A": a, "B": b}), table({"A": a[:230]})
        assert alone.equals(together)
        assert alone.head(230).reset_index(drop=True).equals(cut)


def test_rsi_and_band_ranges(spark, sf_dir):
    from catalog.registry import bars

    df = indicator(bars(spark, sf_dir), ind.rsi_recipe((14,)), ind.bollinger_recipe())
    assert df.filter("rsi_14 < 0 or rsi_14 > 100").count() == 0
    assert df.filter("bb_lower_20 > bb_middle_20 or bb_middle_20 > bb_upper_20").count() == 0


def test_backtest_of_a_known_series(make_bars):
    closes = [10.0] * 3 + [11.0, 12.0, 13.0, 12.0, 11.0, 10.0, 9.0]
    sig = bt.ma_crossover(make_bars({"A": closes}), 2, 3)
    assert values(sig, "signal") == [0, 0, 0, 1, 1, 1, 1, 0, 0, 0]
    ret = bt.strategy_returns(sig, 100.0)
    m = bt.performance_metrics(ret, 100.0).first()
    growth = (12 / 11) * (13 / 12) * (12 / 13) * (11 / 12)
    assert m["final_value"] == pytest.approx(100 * growth)
    assert m["total_trades"] == 4 and m["win_rate_pct"] == 50.0


def test_single_bar_symbol_in_screens(make_bars):
    b = make_bars({"A": [10.0], "B": [10.0, 11.0]})
    rows = {r["symbol"]: r for r in sc.market_screen(b).collect()}
    assert rows["A"]["today_pct"] == 0.0 and rows["A"]["day1_close"] is None
    assert rows["B"]["today_pct"] == 10.0
    assert sc.summary_card(b).filter("symbol = 'A'").first()["change_pct"] == 0.0


def test_paging_covers_everything_once(make_bars):
    b = make_bars({f"S{i:02d}": [10.0, 10.0 + i % 4] for i in range(23)})
    seen = []
    for number in range(1, 6):
        pg = sc.market_screen(b, sort_by="today_pct", ascending=False, page_number=number, per_page=5)
        seen += [r["symbol"] for r in pg.collect()]
    assert len(seen) == 23 == len(set(seen))


def test_bad_sort_column_and_criteria_are_refused(make_bars):
    b = make_bars({"A": [1.0, 2.0]})
    with pytest.raises(ValueError):
        sc.market_screen(b, sort_by="1; drop")
    with pytest.raises(ValueError):
        sc.filter_symbols(b, {"nonsense": 1})
    with pytest.raises(ValueError):
        val.top_symbols(b, metric="close")


def test_search_ignores_case_and_binds_text(make_bars):
    b = make_bars({"INFY": [1.0], "TCS": [1.0]})
    assert [r["symbol"] for r in clean.search_symbols(b, "inf").collect()] == ["INFY"]
    assert clean.search_symbols(b, "%' OR '1'='1").count() == 0


def test_asof_match_between_bars(make_bars, spark):
    b = make_bars(rows=[("A", dt.date(2020, 1, d), 1.0, 1.0, 1.0, float(d), 1) for d in (1, 6, 9)])
    p = spark.createDataFrame([("A", dt.date(2020, 1, d), 1.0, 1.0, 1.0, 50.0) for d in (3, 6, 9)],
                              "symbol string, made_on date, predicted_price double, current_price double, predicted_change_pct double, confidence double")
    got = {r["made_on"].day: r["actual_price"] for r in val.match_asof(p, b).collect()}
    assert got == {3: 6.0, 6: 9.0}


def test_strategy_adjustment_directions(spark):
    def book(acc):
        v = spark.createDataFrame([(acc,)], "accuracy double")
        return {r["name"]: r for r in st.adjust_strategies(v).collect()}

    assert book(50.0)["aggressive"]["buy_threshold"] == pytest.approx(1.2)
    assert book(90.0)["conservative"]["confidence_min"] == 75.0
    assert book(70.0)["moderate"]["position_size"] == pytest.approx(0.2)


def test_recommendation_reasons(spark):
    p = spark.createDataFrame([("A", dt.date(2020, 1, 1), 1.5, 65.0), ("B", dt.date(2020, 1, 1), -3.0, 85.0)],
                              "symbol string, prediction_date date, predicted_change_pct double, confidence double")
    rows = {(r["symbol"], r["strategy"]): r for r in st.recommend(p).collect()}
    assert set(rows) == {("A", "aggressive"), ("B", "aggressive"), ("B", "moderate"), ("B", "conservative")}
    assert rows[("A", "aggressive")]["reason"] == "Predicted +1.50% > threshold 1.00%"
    assert rows[("B", "conservative")]["action"] == "SELL"


def test_forecast_with_few_rows(make_bars):
    r = fc.trend_forecast(make_bars({"A": [10.0, 12.0], "B": [5.0]})).orderBy("symbol").collect()
    assert r[0]["predicted_change_pct"] == pytest.approx((12 - 11) / 11 * 100 * 0.6 * 0.3)
    assert r[1]["confidence"] == 70.0


def test_hot_symbol_keeps_every_row(spark):
    """A third of all trades in one symbol and a single day collapse before the windows."""
    from barloom.sources.derive import bars_from_trades

    n = 60000
    t = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50 + 1).alias("symbol"),
        F.when(F.col("id") % 3 == 0, F.lit("2020-01-01").cast("date")).otherwise(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 97).cast("int"))).alias("date"),
        F.col("id").cast("decimal(38,0)").alias("seq"), F.col("id").cast("double").alias("price"), F.lit(1).alias("volume"))
    b = bars_from_trades(t)
    hot = b.filter("symbol = 0").collect()
    assert len(hot) == 1 and hot[0]["volume"] == n // 3 and hot[0]["open"] == 0.0 and hot[0]["close"] == n - 3
    assert b.agg(F.sum("volume")).first()[0] == n
