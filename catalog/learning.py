"""Models over all symbols. Small settings: the registered queries check behaviour, not accuracy."""

from pyspark.sql import functions as F

from barloom.operators import learning as ml
from barloom.operators.clean import feature_columns
from barloom.operators.ewm import blockwise, macd_set
from barloom.operators import indicators as ind
from barloom.functions.series import add_layers, nxt, strip_temps
from barloom.plans.features import features_ensemble
from catalog.registry import TAME, lead, register, statement, tame

SMALL = {
    "ridge": {},
    "random_forest": {"numTrees": 10, "maxDepth": 5},
    "gradient_boosting": {"maxIter": 5, "maxDepth": 3},
}
SCALED = ["open", "high", "low", "close"]


@register("standard_scaling", statement(TAME, "bars", "symbol, date",
          {c: f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ()" for c in SCALED}))
def _(spark, d):
    return ml.scaled_columns(tame(spark, d), SCALED, "standard")


@register("minmax_scaling", statement(TAME, "bars", "symbol, date",
          {c: f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())" for c in SCALED}))
def _(spark, d):
    return ml.scaled_columns(tame(spark, d), SCALED, "minmax")


@register("robust_scaling", statement(TAME, "bars", "symbol, date",
          {c: f"({c} - quantile_cont({c}, 0.5) OVER ()) / (quantile_cont({c}, 0.75) OVER () - quantile_cont({c}, 0.25) OVER ())" for c in SCALED}))
def _(spark, d):
    return ml.scaled_columns(tame(spark, d), SCALED, "robust")


def _next_close(spark, d):
    return ml.materialised(tame(spark, d).withColumn("target", nxt("close")))


@register("pooled_linear_model", statement(
    [TAME, f"t AS (SELECT *, {lead('close')} AS target FROM bars)"], "t", "",
    {"slope": "regr_slope(target, close) * stddev_samp(close)", "center": "regr_intercept(target, close) + regr_slope(target, close) * avg(close)"},
    where="WHERE target IS NOT NULL"))
def _(spark, d):
    fitted = ml.fit(_next_close(spark, d), ["close"], "target", {"linear": {}})
    last = fitted.models["linear"].stages[-1]
    # The fitted numbers, attached to a one-row aggregate of the data they were fitted on.
    return tame(spark, d).agg(
        F.max(F.lit(float(last.coefficients[0]))).alias("slope"), F.max(F.lit(float(last.intercept))).alias("center")
    )


@register("linear_penalties")
def _(spark, d):
    df = ml.materialised(features_ensemble(tame(spark, d)))
    feats = feature_columns(df)
    train, test = ml.split_at_date(df)
    fitted = ml.fit(train, feats, "target", {"linear": {}, "ridge": {}, "lasso": {}, "elastic": {}}, scale="robust")
    return ml.evaluate(fitted, test, ensemble=False)


@register("ensemble_models")
def _(spark, d):
    df = ml.materialised(features_ensemble(tame(spark, d)))
    train, test = ml.split_at_date(df)
    return ml.evaluate(ml.fit(train, feature_columns(df), "target", SMALL), test)


@register("weighted_ensemble")
def _(spark, d):
    df = ml.materialised(features_ensemble(tame(spark, d)))
    train, test = ml.split_at_date(df)
    fitted = ml.fit(train, feature_columns(df), "target", {"ridge": {}, "lasso": {}, "random_forest": SMALL["random_forest"]})
    return ml.evaluate(ml.weigh(fitted, ml.evaluate(fitted, test)), test)


@blockwise
def _polynomial_columns(df):
    b = macd_set(df, [(12, 26, 9)], also={"ema_20": ("close", 20)})
    return add_layers(
        b, ind.sma_recipe((20,)), ind.rsi_recipe((14,)), ind.bollinger_recipe(), ind.stochastic_recipe(((14, 3),)),
        ind.lag_recipe(("close",)), [ind.simple_return(), ind.lag_recipe(("returns",), (1,))[0]], [{"target": nxt("close")}])


@register("polynomial_model")
def _(spark, d):
    df = strip_temps(_polynomial_columns(tame(spark, d)))
    df = ml.materialised(df.select("symbol", "date", "target", *ml.POLYNOMIAL_INPUTS))
    train, test = ml.split_at_date(df)
    return ml.fit_polynomial(train, test)[1]


def _universal(spark, d):
    df, feats = ml.stored_universal_table(tame(spark, d))
    train, test = ml.split_at_date(df)
    models = {k: SMALL[k] for k in ("random_forest", "gradient_boosting")}
    return df, test, ml.fit(train, feats, "target_return", models, copy=False)


@register("universal_models")
def _(spark, d):
    _, test, fitted = _universal(spark, d)
    return ml.evaluate(fitted, test)


@register("universal_forecasts")
def _(spark, d):
    df, _, fitted = _universal(spark, d)
    return ml.predict_latest(fitted, df)


@register("feature_importance")
def _(spark, d):
    df = ml.materialised(features_ensemble(tame(spark, d)))
    fitted = ml.fit(df, feature_columns(df), "target", {"random_forest": SMALL["random_forest"]})
    return ml.importance(fitted, "random_forest", spark)


@register("settings_search")
def _(spark, d):
    df = ml.materialised(features_ensemble(tame(spark, d)))
    return ml.search(df, feature_columns(df), "target", "random_forest", {"numTrees": [5], "maxDepth": [2, 4]})


@register("model_per_symbol")
def _(spark, d):
    df = features_ensemble(tame(spark, d))
    return ml.fit_per_symbol(df, feature_columns(df))


@register("saved_model_forecasts")
def _(spark, d):
    from barloom.shared import fresh_path
    from barloom.sources.store import load_model, save_model

    df = ml.materialised(features_ensemble(tame(spark, d)))
    feats = feature_columns(df)
    fitted = ml.fit(df, feats, "target", {"ridge": {}})
    path = fresh_path(spark, "model")
    save_model(fitted.models["ridge"], path, ml.evaluate(fitted, df))
    again = load_model(path).transform(ml.latest_complete(df, feats))
    return again.select("symbol", "date", "close", F.col("prediction").alias("predicted_price"))


@register("saved_ensemble_forecasts")
def _(spark, d):
    """A weighted ensemble, weighted on a validation part, saved and loaded; scored rows lack one feature."""
    from barloom.shared import fresh_path

    df = ml.materialised(features_ensemble(tame(spark, d)))
    feats = feature_columns(df)
    train, rest = ml.split_at_date(df, 0.6)
    validation, test = ml.split_at_date(rest, 0.5)
    fitted = ml.fit(train, feats, "target", {"ridge": {}, "lasso": {}})
    path = fresh_path(spark, "ensemble")
    ml.weigh(fitted, ml.evaluate(fitted, validation)).save(path, spark)
    again = ml.FittedModels.load(path, spark)
    complete = ml.training_rows(test, feats).drop(feats[-1])
    return again.transform(complete).select("symbol", "date", ml.combined(again).alias("predicted_price"))
