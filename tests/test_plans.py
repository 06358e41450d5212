"""What the physical plans must look like."""

import re

import pytest

from barloom.operators import screens as sc
from barloom.plans import features as bundles
from barloom.sources import store
from catalog.registry import QUERIES, bars


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "bars")
    store.write_bars(bars(spark, sf_dir), path, 4)
    return path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bundle", ["features_basic", "features_forecast", "features_trend", "features_full", "features_universal"])
def test_a_bundle_shuffles_once_and_sorts_twice_at_most(spark, stored, bundle):
    p = plan(getattr(bundles, bundle)(store.read_bars(spark, stored)))
    assert len(re.findall(r"Exchange ", p)) == 1
    assert "hashpartitioning(symbol" in p
    assert len(re.findall(r"- Sort ", p)) <= 2
    assert "Python" not in p and "Join" not in p


@pytest.mark.parametrize("bundle", ["features_basic", "features_forecast", "features_full", "features_universal"])
def test_a_bundle_with_averages_sorts_the_bare_bars_only(spark, stored, bundle):
    p = plan(getattr(bundles, bundle)(store.read_bars(spark, stored)))
    assert len(re.findall(r"- Sort ", p)) == 1


@pytest.mark.parametrize("bundle", ["features_full", "features_universal"])
def test_averages_pass_bare_bars_only(spark, stored, bundle):
    df = getattr(bundles, bundle)(store.read_bars(spark, stored))
    node, widths = df._jdf.queryExecution().optimizedPlan(), []
    while node.children().size():
        if node.nodeName() == "Window":
            widths.append(node.output().size())
        node = node.children().apply(0)
    assert max(widths[-6:]) < len(df.columns)   # the first six passes, which are averages


def test_the_screen_limits_before_its_shuffle(spark, stored):
    import datetime as dt

    from pyspark.sql import functions as F

    p = plan(sc.market_screen(store.read_bars(spark, stored), F.lit(dt.date(2001, 10, 1))))
    assert "WindowGroupLimit" in p and len(re.findall(r"Exchange hashpartitioning", p)) <= 2
    assert p.rindex("Partial") > p.index("Exchange hashpartitioning(symbol")
    assert "partial_max" in p and "GreaterThanOrEqual(date" in p


def test_paging_is_a_top_k(spark, stored):
    p = plan(sc.market_screen(store.read_bars(spark, stored), sort_by="today_pct", page_number=2, per_page=10))
    assert "TakeOrderedAndProject" in p


def test_bars_combine_before_the_shuffle(spark, sf_dir):
    p = plan(bars(spark, sf_dir))
    assert "partial_min_by" in p and "SortAggregate" not in p
    assert "l_comment" not in p and "l_tax" not in p


def test_one_symbol_reads_one_bucket(spark, stored):
    p = plan(store.read_bars(spark, stored, symbol=7, buckets=4))
    assert re.search(r"PartitionFilters: \[.*bucket", p)
    assert re.search(r"PushedFilters: \[.*EqualTo\(symbol,7\)", p)


def test_latest_rows_are_limited_inside_the_window(spark, stored):
    assert "WindowGroupLimit" in plan(sc.recent_ranked(store.read_bars(spark, stored)).filter("rn <= 32"))


def test_recommendations_neither_join_nor_shuffle_predictions(spark, sf_dir):
    p = plan(QUERIES["strategy_recommendations"](spark, sf_dir))
    assert "Join" not in p and "CartesianProduct" not in p


def test_a_processed_table_is_stored_without_moving_or_sorting_wide_rows(spark, sf_dir, tmp_path):
    from pyspark.sql import functions as F

    from barloom.plans.cycles import process_bars

    plans = []

    def process(df):
        out = process_bars(df)
        plans.append(plan(out.drop("__slice").sortWithinPartitions("bucket")))
        return out

    src = bars(spark, sf_dir)
    store.write_processed(src, process, str(tmp_path / "p"), 4)
    assert len(re.findall(r"Exchange ", plans[0])) == 2   # bars, their buckets
    assert len(re.findall(r"- Sort ", plans[0])) == 1
    got, want = store.read_bars(spark, str(tmp_path / "p")), process_bars(src)
    assert got.columns == want.columns
    digest = [F.count("*"), *[F.sum(F.xxhash64("symbol", "date", F.round(F.col(c).cast("double"), 6)).cast("decimal(38,0)")) for c in got.columns[2:]]]
    assert got.agg(*digest).first() == want.agg(*digest).first()
    buckets = spark.read.parquet(str(tmp_path / "p")).groupBy("symbol").agg(F.count_distinct("bucket").alias("n"), F.min("bucket").alias("b"))
    assert buckets.where((F.col("n") != 1) | (F.col("b") != store._bucket(4))).count() == 0
