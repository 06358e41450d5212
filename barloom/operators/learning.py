"""Pooled and per-symbol models on MLlib: one fit over all symbols instead of a loop.

Training tables are split at a date, so that no model sees the future of any symbol,
and written once to the shared folder because every estimator passes over them many
times.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.feature import MinMaxScaler, RobustScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import clip
from barloom.functions.series import ratio
from barloom.operators.clean import date_cutoff, feature_columns, training_rows
from barloom.operators.forecast import regression_metrics
from barloom.operators.quantiles import robust_scaled
from barloom.operators.upkeep import symbol_codes
from barloom.plans.features import UNIVERSAL_EXCLUDED, features_universal
from barloom.shared import fresh_path

SEED = 42


# --- training tables --------------------------------------------------------------

def materialised(df: DataFrame, purpose="training", compression=None) -> DataFrame:
    path = fresh_path(df.sparkSession, purpose)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.parquet(path)


def universal_table(bars: DataFrame) -> tuple[DataFrame, list[str]]:
    """Universal features with the symbol code; the table keeps label-less newest rows."""
    df = features_universal(bars).join(symbol_codes(bars), "symbol")
    return df, feature_columns(df, exclude=UNIVERSAL_EXCLUDED)


def stored_universal_table(bars: DataFrame, label="target_return") -> tuple[DataFrame, list[str]]:
    """The universal table as models need it, written once: key, close, features and label."""
    df, features = universal_table(bars)
    return materialised(df.select("symbol", "date", "close", *features, label), compression="zstd"), features


def split_at_date(df: DataFrame, train=0.8) -> tuple[DataFrame, DataFrame]:
    cut = df.select(date_cutoff(df, train)).first()[0]
    return df.filter(F.col("date") < F.lit(cut)), df.filter(F.col("date") >= F.lit(cut))


# --- estimators -----------------------------------------------------------------------

def scaler(kind="standard"):
    options = {"inputCol": "assembled", "outputCol": "features"}
    if kind == "standard":
        return StandardScaler(withMean=True, withStd=True, **options)
    if kind == "minmax":
        return MinMaxScaler(**options)
    if kind == "robust":
        return RobustScaler(withCentering=True, withScaling=True, **options)
    raise ValueError(f"unknown scaler {kind!r}")


def linear(name: str, rows: int, alpha=None, l1_ratio=0.5):
    """Least squares with the usual penalties; features come scaled already.

    A ridge penalty on the summed squared error is divided by the number of rows,
    because Spark's objective is a mean; lasso and elastic net are means already.
    """
    # Default penalty strengths.
    defaults = {"linear": 0.0, "ridge": 1.0, "lasso": 0.1, "elastic": 0.1}
    alpha = defaults[name] if alpha is None else alpha
    penalty = {"linear": (0.0, 0.0), "ridge": (alpha / rows, 0.0), "lasso": (alpha, 1.0),
               "elastic": (alpha, l1_ratio)}[name]
    return LinearRegression(regParam=penalty[0], elasticNetParam=penalty[1], standardization=False)


def estimator(name: str, rows: int, **settings):
    if name in ("linear", "ridge", "lasso", "elastic"):
        return linear(name, rows, **settings)
    if name == "random_forest":
        return RandomForestRegressor(**({"numTrees": 200, "maxDepth": 15, "minInstancesPerNode": 5, "seed": SEED} | settings))
    if name == "gradient_boosting":
        return GBTRegressor(**({"maxIter": 100, "stepSize": 0.1, "maxDepth": 5, "seed": SEED} | settings))
    raise ValueError(f"unknown model {name!r}")


@dataclass
class FittedModels:
    features: list[str]
    label: str
    models: dict[str, PipelineModel]
    weights: dict[str, float] = field(default_factory=dict)

    def save(self, path: str, spark) -> None:
        """The preparation once, every model, and features, label and weights as one JSON line."""
        prepare = PipelineModel(next(iter(self.models.values())).stages[:-1])
        prepare.write().overwrite().save(f"{path}/prepare")
        for name, model in self.models.items():
            PipelineModel([model.stages[-1]]).write().overwrite().save(f"{path}/models/{name}")
        about = {"features": self.features, "label": self.label, "models": list(self.models), "weights": self.weights}
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, path: str, spark) -> FittedModels:
        about = json.loads(spark.read.text(f"{path}/about").first()["value"])
        prepare = PipelineModel.load(f"{path}/prepare").stages
        models = {n: PipelineModel([*prepare, *PipelineModel.load(f"{path}/models/{n}").stages]) for n in about["models"]}
        return cls(about["features"], about["label"], models, about["weights"])

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds one ``prediction_<model>`` column per model, assembling and scaling once; features the table lacks are 0."""
        df = df.withColumns({f: F.lit(0.0) for f in self.features if f not in df.columns})
        prepare = PipelineModel(next(iter(self.models.values())).stages[:-1])
        out = prepare.transform(df)
        for name, model in self.models.items():
            last = model.stages[-1].copy({model.stages[-1].predictionCol: f"prediction_{name}"})
            out = last.transform(out)
        return out.drop("assembled", "features")


def fit(train: DataFrame, features: list[str], label: str, models: dict[str, dict], scale="standard", copy=True) -> FittedModels:
    """Fit several models on one assembled and scaled training table.

    Without ``copy`` that table is not written: every pass assembles and scales the rows of
    ``train`` again, which takes no second copy of a wide table that is stored already.
    """
    rows = training_rows(train, [*features, label])
    assembler = VectorAssembler(inputCols=features, outputCol="assembled")
    scaling = scaler(scale).fit(assembler.transform(rows))
    prepared = PipelineModel([assembler, scaling]).transform(rows).select("features", F.col(label).alias("label"))
    prepared = materialised(prepared) if copy else prepared
    count = prepared.count()
    fitted = {
        name: PipelineModel([assembler, scaling, estimator(name, count, **settings).fit(prepared)])
        for name, settings in models.items()
    }
    return FittedModels(features, label, fitted)


def evaluate(fitted: FittedModels, test: DataFrame, ensemble=True) -> DataFrame:
    """Error metrics of every model, and of their (weighted) mean, from one pass."""
    scored = fitted.transform(training_rows(test, [*fitted.features, fitted.label]))
    options = {n: F.col(f"prediction_{n}") for n in fitted.models}
    if ensemble:
        options["ensemble"] = combined(fitted)
    pairs = F.array(*[F.struct(F.lit(n).alias("model"), c.alias("p")) for n, c in options.items()])
    long = scored.select(F.col(fitted.label).alias("actual"), F.explode(pairs).alias("m"))
    long = long.select("actual", F.col("m.model").alias("model"), F.col("m.p").alias("predicted"))
    return regression_metrics(long, by=["model"])


def weigh(fitted: FittedModels, metrics: DataFrame, score="accuracy") -> FittedModels:
    """Weights proportional to the scores: one small row per model."""
    rows = {r["model"]: max(0.0, r[score] or 0.0) for r in metrics.filter("model <> 'ensemble'").collect()}
    total = sum(rows.values())
    weights = {n: s / total for n, s in rows.items()} if total else {}
    return FittedModels(fitted.features, fitted.label, fitted.models, weights)


def combined(fitted: FittedModels):
    names = list(fitted.models)
    weights = fitted.weights or {n: 1.0 / len(names) for n in names}
    terms = [F.lit(weights.get(n, 0.0)) * F.col(f"prediction_{n}") for n in names]
    return sum(terms[1:], terms[0])


def latest_complete(df: DataFrame, features: list[str]) -> DataFrame:
    """The newest row of every symbol whose features are all present; no label needed."""
    rows = training_rows(df, features).select("symbol", "date", "close", *features)
    newest = rows.groupBy("symbol").agg(F.max_by(F.struct("date", "close", *features), "date").alias("r"))
    return newest.select("symbol", "r.*")


def predict_latest(fitted: FittedModels, df: DataFrame) -> DataFrame:
    """Next-day forecast of every symbol from the models' mean predicted return.

    Confidence falls with the disagreement (population deviation) of the models.
    """
    out = fitted.transform(latest_complete(df, fitted.features))
    cols = [F.col(f"prediction_{n}") for n in fitted.models]
    mean = sum(cols[1:], cols[0]) / len(cols)
    out = out.withColumns({"__mean": mean, "__ret": combined(fitted)})
    squares = [F.pow(c - F.col("__mean"), 2) for c in cols]
    spread = F.sqrt(sum(squares[1:], squares[0]) / len(cols))
    return out.select(
        "symbol", F.date_add("date", 1).alias("prediction_date"), F.col("close").alias("current_price"),
        (F.col("close") * (1 + F.col("__ret"))).alias("predicted_price"),
        (F.col("__ret") * 100).alias("predicted_change_pct"),
        clip(85 - spread * 1000, 50.0, 95.0).alias("confidence"), F.lit("Universal_Ensemble").alias("model_used"),
    )


def importance(fitted: FittedModels, name: str, spark) -> DataFrame:
    """Feature importances of a tree model, absolute coefficients of a linear one."""
    last = fitted.models[name].stages[-1]
    values = last.coefficients if hasattr(last, "coefficients") else last.featureImportances
    rows = [(f, float(abs(v))) for f, v in zip(fitted.features, values.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double")


def scaled_columns(df: DataFrame, features: list[str], kind="standard") -> DataFrame:
    """Scaled copies of the features as ordinary columns; the robust kind by exact quartiles."""
    if kind == "robust":
        return robust_scaled(df, features, ["symbol", "date"])
    assembled = VectorAssembler(inputCols=features, outputCol="assembled").transform(df)
    out = scaler(kind).fit(assembled).transform(assembled).withColumn("__v", vector_to_array("features"))
    return out.select("symbol", "date", *[F.col("__v")[i].alias(f) for i, f in enumerate(features)])


# --- interaction polynomial --------------------------------------------------------------

# Inputs of the interaction polynomial.
POLYNOMIAL_INPUTS = [
    "close_lag_1", "close_lag_2", "close_lag_3", "close_lag_5", "sma_20", "ema_20", "rsi_14",
    "macd_12_26", "bb_position_20", "stoch_k_14_3", "returns_lag_1",
]


def interaction_columns(columns: list[str], degree=3) -> dict:
    """Products of up to ``degree`` different columns, without powers."""
    out = {}
    for k in range(2, degree + 1):
        for chosen in combinations(columns, k):
            term = F.col(chosen[0])
            for c in chosen[1:]:
                term = term * F.col(c)
            out["_x_".join(chosen)] = term
    return out


def fit_polynomial(train: DataFrame, test: DataFrame, inputs=POLYNOMIAL_INPUTS, label="target", degree=3, alpha=10.0):
    """Ridge regression on interactions of scaled inputs; returns the model and test metrics.

    Only the inputs are stored: a pass over them makes the products as it goes, since a table
    of all products is some twenty times as large.
    """
    train, test = (training_rows(d, [*inputs, label]) for d in (train, test))
    assembler = VectorAssembler(inputCols=list(inputs), outputCol="assembled")
    scaling = scaler("standard").fit(assembler.transform(train))

    def scaled(df):
        out = scaling.transform(assembler.transform(df)).withColumn("v", vector_to_array("features"))
        return out.select(F.col(label).alias("label"), *[F.col("v")[i].alias(c) for i, c in enumerate(inputs)])

    def widen(flat):
        crossed = interaction_columns(list(inputs), degree)
        wide = flat.withColumns(crossed)
        names = [*inputs, *crossed]
        return VectorAssembler(inputCols=names, outputCol="features").transform(wide).select("label", "features")

    table = materialised(scaled(train))
    model = linear("ridge", table.count(), alpha).fit(widen(table))
    scored = model.transform(widen(scaled(test))).select(F.col("label").alias("actual"), F.col("prediction").alias("predicted"))
    return model, regression_metrics(scored).withColumn("model", F.lit("polynomial"))


# --- search -------------------------------------------------------------------------------

def search(df: DataFrame, features: list[str], label: str, name: str, grid: dict[str, list], folds=3) -> DataFrame:
    """Mean validation error of every grid point over expanding, time-ordered folds."""
    rows = training_rows(df, [*features, label]).select("date", *features, label)
    day = F.unix_date("date").cast("double")
    shares = [F.lit(i / (folds + 1)) for i in range(1, folds + 1)]
    cuts = rows.groupBy(day.alias("d")).agg(F.count(F.lit(1)).alias("n")).agg(
        F.percentile("d", F.array(*shares), F.col("n"))
    ).first()[0]
    edges = [*cuts, float("inf")]
    results = []
    for values in product(*grid.values()):
        settings = dict(zip(grid, values))
        for i in range(folds):
            part = fit(rows.filter(day < edges[i]), features, label, {name: settings})
            check = rows.filter((day >= edges[i]) & (day < edges[i + 1]))
            mse = evaluate(part, check, ensemble=False).select("mse").first()[0]
            results.append((str(settings), i, float(mse)))
    scored = df.sparkSession.createDataFrame(results, "settings string, fold int, mse double")
    return scored.groupBy("settings").agg(F.avg("mse").alias("mean_mse"), F.count(F.lit(1)).alias("folds"))


# --- one model per symbol --------------------------------------------------------------------

PER_SYMBOL_COLUMNS = (
    "train_rows long, test_rows long, mape double, accuracy double, intercept double, "
    "coefficients array<double>, current_price double, predicted_price double"
)


def _ridge(x: np.ndarray, y: np.ndarray, alpha: float):
    """Coefficients on standardised columns, with the column means and deviations."""
    mean, std = x.mean(axis=0), x.std(axis=0)
    std[std == 0] = 1.0
    z = (x - mean) / std
    center = y.mean()
    w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - center))
    return w, center, mean, std


def fit_per_symbol(df: DataFrame, features: list[str], label="target", alpha=1.0, min_rows=100, train=0.8) -> DataFrame:
    """Ridge regression on each symbol's own series, scored on its last fifth.

    A group is one series at the daily grain, so its size is bounded by the calendar.
    """
    rows = training_rows(df, features).select("symbol", "date", "close", label, *features)
    key_type = dict(rows.dtypes)["symbol"]

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("date")
        known = part[part[label].notna()]
        if len(part) < min_rows or len(known) < 2:
            return pd.DataFrame()
        cut = int(len(known) * train)
        x, y = known[features].to_numpy(float), known[label].to_numpy(float)
        w, center, mean, std = _ridge(x[:cut], y[:cut], alpha)
        guess = (x[cut:] - mean) / std @ w + center
        mape = float(np.mean(np.abs((y[cut:] - guess) / y[cut:])) * 100)
        newest = part.iloc[-1]
        ahead = float((newest[features].to_numpy(float) - mean) / std @ w + center)
        return pd.DataFrame({
            "symbol": [key[0]], "train_rows": [cut], "test_rows": [len(known) - cut], "mape": [mape],
            "accuracy": [max(0.0, 100 - mape)], "intercept": [float(center)], "coefficients": [list(map(float, w))],
            "current_price": [float(newest["close"])], "predicted_price": [ahead],
        })

    fitted = rows.groupBy("symbol").applyInPandas(one, f"symbol {key_type}, {PER_SYMBOL_COLUMNS}")
    change = ratio(F.col("predicted_price") - F.col("current_price"), "current_price") * 100
    return fitted.withColumn("predicted_change_pct", change)
