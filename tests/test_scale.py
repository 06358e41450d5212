"""How the work of the wide bundles, their stored tables and the rounding of results is laid out."""

import math
import random
import re

from pyspark.sql import functions as F

from barloom.functions.series import add_layers, prev
from barloom.operators import indicators as ind
from barloom.operators import learning as ml
from barloom.operators.clean import training_rows
from barloom.plans import features as bundles
from catalog.registry import half_up


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rounding_without_text_is_exact(spark):
    r = random.Random(7)
    values = [s * x for s in (1, -1) for x in (0.0, 0.5, 2.5, 1e-7, 0.00005, 2.00005, 1.0000005, 2058.8259375, 1e15, 1e300, math.inf)]
    values += [r.uniform(-1, 1) * 10 ** r.uniform(-9, 17) for _ in range(20_000)]
    values += [(r.randrange(10**6) + 0.5) / 10**d for d in (4, 5, 6) for _ in range(2_000)]
    df = spark.createDataFrame([(float(v),) for v in [*values, math.nan]] + [(None,)], "x double")
    for digits in (4, 5, 6):
        same = half_up(F.col("x"), digits).eqNullSafe(F.round("x", digits))
        assert df.filter(~same).count() == 0


def test_the_full_bundle_deals_its_bars_over_more_tasks_than_cores(spark, make_bars):
    p = plan(bundles.features_full(make_bars({f"s{i}": [1.0, 2.0, 3.0] for i in range(4)})))
    found = re.findall(r"Exchange hashpartitioning\(symbol#\d+, (\d+)\), (\w+)", p)
    assert len(found) == 1 and found[0][1] == "REPARTITION_BY_NUM"
    assert int(found[0][0]) >= 4 * spark.sparkContext.defaultParallelism


def test_late_layers_give_the_same_columns_and_pass_fewer(spark, make_bars):
    df = make_bars({"a": [float(x * x % 17 + 1) for x in range(40)], "b": [float(x % 5 + 1) for x in range(30)]})
    recipes = [ind.lag_recipe(), ind.squeeze_recipe(), [{"__up": prev("close")}, {"rise": F.col("close") - F.col("__up")}]]
    early, late = add_layers(df, *recipes), add_layers(df, *recipes, late=True)
    assert early.columns == late.columns
    assert early.exceptAll(late).count() == 0 and late.exceptAll(early).count() == 0

    def passed(out):
        node, total = out._jdf.queryExecution().optimizedPlan(), 0
        while node.children().size():
            node = node.children().apply(0)
            total += node.output().size() if node.nodeName() == "Window" else 0
        return total

    assert passed(late) < passed(early)


def test_training_rows_are_finite_and_present(spark):
    values = [1.0, -0.0, 1e308, math.nan, math.inf, -math.inf, None]
    df = spark.createDataFrame([(v, 3) for v in values] + [(2.0, None)], "x double, n long")
    assert sorted(r["x"] for r in training_rows(df, ["x", "n"]).collect()) == [0.0, 1.0, 1e308]


def test_the_filter_of_many_columns_is_compiled(spark):
    """A method above 8,000 bytes of code is never compiled by the JVM."""
    df = spark.range(5).select(*[(F.col("id") * i).cast("double").alias(f"c{i}") for i in range(40)]).localCheckpoint()
    kept = training_rows(df, df.columns)
    codes = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenStringSeq(
        kept._jdf.queryExecution().executedPlan())
    assert max(codes.apply(i)._3().maxMethodCodeSize() for i in range(codes.size())) < 8000


def test_a_stored_training_table_is_not_written_again(spark, make_bars, monkeypatch):
    bars = make_bars({s: [100.0 + (i * k) % 13 for i in range(90)] for k, s in ((3, "a"), (5, "b"), (7, "c"))})
    table, features = ml.stored_universal_table(bars)
    assert table.columns == ["symbol", "date", "close", *features, "target_return"]
    whole, names = ml.universal_table(bars)
    assert names == features
    part = whole.select(table.columns)
    assert table.exceptAll(part).count() == 0 and part.exceptAll(table).count() == 0
    written, write = [], ml.materialised
    monkeypatch.setattr(ml, "materialised", lambda df, *a, **k: written.append(df) or write(df, *a, **k))
    models = {"ridge": {}}
    copied = ml.fit(table, features, "target_return", models)
    assert len(written) == 1
    plain = ml.fit(table, features, "target_return", models, copy=False)
    assert len(written) == 1
    a, b = (m.models["ridge"].stages[-1].coefficients.toArray() for m in (copied, plain))
    assert abs(a - b).max() < 1e-9
