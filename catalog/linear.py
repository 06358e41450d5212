"""Penalised linear models over moments; with one or two features their solutions are closed forms that SQL can state."""

from pyspark.sql import functions as F

from barloom.functions.series import nxt
from barloom.operators import learning as ml
from barloom.operators import moments as mo
from barloom.operators.clean import feature_columns
from barloom.plans.features import features_ensemble
from catalog.registry import TAME, W, lead, register, statement, tame

ALPHAS = [0.1, 10.0, 1000.0]
_T = f"t AS (SELECT *, {lead('close')} AS target FROM bars)"


def _labelled(spark, d):
    return tame(spark, d).withColumn("target", nxt("close"))


# Stretch i trains on all before it: the moments of the rows before a cut, and the errors of the rows of the stretch.
_FOLDS = [TAME, _T, """u AS MATERIALIZED (SELECT date, (date - DATE '1970-01-01')::DOUBLE AS d, close AS x, target AS y FROM t WHERE target IS NOT NULL),
cuts AS (SELECT quantile_cont(d, [0.25, 0.5, 0.75]) AS c FROM u),
p AS MATERIALIZED (SELECT x, y, (d >= c[1])::INT + (d >= c[2])::INT + (d >= c[3])::INT AS part FROM u, cuts),
m AS MATERIALIZED (
  SELECT f.fold, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, covar_pop(x, y) AS cxy
  FROM p JOIN (SELECT unnest([0, 1, 2]) AS fold) f ON p.part <= f.fold GROUP BY f.fold)"""]


def _searched(models):
    """Statement over (settings, slope) pairs; the slope is that of the raw feature."""
    options = " UNION ALL ".join(f"SELECT '{text}' AS settings, fold, n, mx, my, {slope} AS w FROM m" for text, slope in models.items())
    return statement([*_FOLDS, f"o AS ({options})"], "o JOIN p ON p.part = o.fold + 1", "settings, fold, any_value(n) AS train_rows, count(*) AS test_rows",
                     {"mse": "avg((y - my - w * (x - mx)) ** 2)"}, tail="GROUP BY settings, fold")


def _soft(alpha, ratio):
    """Slope of one standardised feature under alpha (ratio |w| + (1 - ratio) w^2 / 2), back on the raw scale."""
    c = "cxy / sqrt(vx)"
    return f"sign({c}) * greatest(abs({c}) - {alpha * ratio}, 0) / (1 + {alpha * (1 - ratio)}) / sqrt(vx)"


@register("ridge_search", _searched({f"name=ridge, alpha={a}": f"(n * cxy / sqrt(vx)) / (n + {a}) / sqrt(vx)" for a in ALPHAS}))
def _(spark, d):
    return mo.search_linear(_labelled(spark, d), ["close"], "target", {"name": ["ridge"], "alpha": ALPHAS})


@register("lasso_and_elastic_search", _searched(
    {f"name=lasso, alpha={a}, l1_ratio={r}": _soft(a, 1.0) for a in (0.1, 1.0) for r in (0.3, 0.8)}
    | {f"name=elastic, alpha={a}, l1_ratio={r}": _soft(a, r) for a in (0.1, 1.0) for r in (0.3, 0.8)}))
def _(spark, d):
    return mo.search_linear(_labelled(spark, d), ["close"], "target", {"name": ["lasso", "elastic"], "alpha": [0.1, 1.0], "l1_ratio": [0.3, 0.8]})


# Two standardised features with correlation r: (n [[1, r], [r, 1]] + alpha I) w = n (c1, c2).
_TWO = [TAME, _T, f"""u AS (SELECT symbol, date, close AS x1, volume::DOUBLE AS x2, target AS y, row_number() OVER {W} AS rn,
  count(*) OVER (PARTITION BY symbol) AS size FROM t WHERE target IS NOT NULL),
p AS MATERIALIZED (SELECT *, rn <= floor(size * 0.8) AS train FROM u WHERE size >= 100),
m AS MATERIALIZED (
  SELECT symbol, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2,
         covar_pop(x1, x2) / stddev_pop(x1) / stddev_pop(x2) AS r, covar_pop(x1, y) / stddev_pop(x1) AS c1, covar_pop(x2, y) / stddev_pop(x2) AS c2
  FROM p WHERE train GROUP BY symbol),
a AS (SELECT * FROM (VALUES ('linear', 0.0), ('ridge', 5.0)) v(model, alpha)),
w AS (SELECT m.*, model, n * ((n + alpha) * c1 - n * r * c2) / ((n + alpha) ** 2 - (n * r) ** 2) / s1 AS w1,
             n * ((n + alpha) * c2 - n * r * c1) / ((n + alpha) ** 2 - (n * r) ** 2) / s2 AS w2 FROM m, a)"""]


@register("linear_per_symbol", statement(_TWO, "w JOIN p USING (symbol)", "symbol, model, any_value(n) AS train_rows, count(*) AS test_rows",
          {"w1": "any_value(w.w1)", "w2": "any_value(w.w2)", "intercept": "any_value(my - w1 * m1 - w2 * m2)",
           "mse": "avg((y - my - w1 * (x1 - m1) - w2 * (x2 - m2)) ** 2)"}, where="WHERE NOT train", tail="GROUP BY symbol, model"))
def _(spark, d):
    df = _labelled(spark, d).withColumn("volume", F.col("volume").cast("double"))
    found = mo.linear_per_symbol(df, ["close", "volume"], "target", {"linear": {"name": "linear"}, "ridge": {"name": "ridge", "alpha": 5.0}})
    return found.select("symbol", "model", "train_rows", "test_rows", "intercept", F.col("coefficients")[0].alias("w1"), F.col("coefficients")[1].alias("w2"), "mse")


@register("penalty_search_all_features")
def _(spark, d):
    """The whole ensemble bundle; its solutions are held against direct ones in the tests."""
    df = ml.materialised(features_ensemble(tame(spark, d)))
    return mo.search_linear(df, feature_columns(df), "target", {"name": ["ridge", "lasso", "elastic"], "alpha": [0.01, 0.1, 1.0, 10.0]})
