"""Linear models from additive moments: one pass over the rows, every penalty and fold afterwards.

A part of the data is summarised by its number of rows, the column means and the matrix of centred
products. Two summaries merge exactly into that of their union without cancellation, so each task
summarises its rows, summaries are merged by a tree, and what reaches the driver is one small matrix per
part, whatever the number of rows. From it follow least squares and ridge in closed form, lasso and elastic
net by coordinate descent, and the squared error of any of them on any other part.

Rows with a missing or infinite value in a column that is used are left out. A constant column gets the
coefficient 0. Parts are expected to be few (folds, splits); for one model per symbol see ``linear_per_symbol``.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.clean import training_rows

FAN_IN = 64


@dataclass
class Moments:
    """Rows, means and centred products of some columns."""

    n: float
    mean: np.ndarray
    m2: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> Moments:
        if not len(rows):
            return cls.empty(rows.shape[1])
        mean = rows.mean(axis=0)
        centred = rows - mean
        return cls(float(len(rows)), mean, centred.T @ centred)

    @classmethod
    def empty(cls, width: int) -> Moments:
        return cls(0.0, np.zeros(width), np.zeros((width, width)))

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return self
        apart = other.mean - self.mean
        return Moments(n, self.mean + apart * (other.n / n), self.m2 + other.m2 + np.outer(apart, apart) * (self.n * other.n / n))


@dataclass
class Linear:
    """``label = intercept + coefficients . features``, on the raw scale."""

    intercept: float
    coefficients: np.ndarray

    def predict(self, features: list[str]) -> Column:
        out = F.lit(float(self.intercept))
        for name, w in zip(features, self.coefficients):
            out = out + F.lit(float(w)) * F.col(name)
        return out

    def mse(self, part: Moments) -> float:
        """Mean squared error over the rows of ``part`` (features, then label), from its moments alone."""
        w = np.append(-self.coefficients, 1.0)
        bias = part.mean @ w - self.intercept
        return float(w @ part.m2 @ w / part.n + bias * bias)


def _descent(g: np.ndarray, c: np.ndarray, l1: float, l2: float, sweeps: int = 10_000, tolerance: float = 1e-13) -> np.ndarray:
    """Coordinate descent for w'gw/2 - c'w + l1 |w| + l2 w'w/2."""
    w = np.zeros(len(c))
    pull = np.zeros(len(c))  # g @ w
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(c)):
            if not g[j, j]:
                continue
            rest = c[j] - pull[j] + g[j, j] * w[j]
            new = np.sign(rest) * max(abs(rest) - l1, 0.0) / (g[j, j] + l2)
            if new != w[j]:
                pull += g[:, j] * (new - w[j])
                moved = max(moved, abs(new - w[j]))
                w[j] = new
        if moved <= tolerance * max(1.0, np.abs(w).max(initial=0.0)):
            break
    return w


def fit_linear(train: Moments, name: str = "ridge", alpha: float = 1.0, l1_ratio: float = 0.5) -> Linear:
    """A model of the last column on the others, which are standardised first.

    ``linear``; ``ridge`` adds alpha |w|^2 to the sum of squares; ``lasso`` and ``elastic`` add alpha times their penalty to
    half the mean of squares.
    """
    p = len(train.mean) - 1
    scale = np.sqrt(np.diag(train.m2)[:p] / train.n)
    varies = scale > 1e-12 * np.maximum(1.0, np.abs(train.mean[:p]))
    divisor = np.where(varies, scale, 1.0)
    z = np.where(np.outer(varies, varies), train.m2[:p, :p] / np.outer(divisor, divisor), 0.0)
    zy = np.where(varies, train.m2[:p, p] / divisor, 0.0)
    if name in ("linear", "ridge"):
        penalty = np.eye(p) * (alpha if name == "ridge" else 0.0) + np.diag((~varies).astype(float))
        w = np.linalg.lstsq(z, zy, rcond=None)[0] if name == "linear" and np.linalg.matrix_rank(z + penalty) < p else np.linalg.solve(z + penalty, zy)
    elif name in ("lasso", "elastic"):
        ratio = 1.0 if name == "lasso" else l1_ratio
        w = _descent(z / train.n, zy / train.n, alpha * ratio, alpha * (1 - ratio))
    else:
        raise ValueError(f"unknown model {name!r}")
    w = np.where(varies, w, 0.0) / divisor
    return Linear(float(train.mean[p] - w @ train.mean[:p]), w)


_PART = "part int, slot int, n double, mean array<double>, m2 array<double>"


def _row(part: int, slot: int, m: Moments) -> dict:
    return {"part": part, "slot": slot, "n": m.n, "mean": m.mean.tolist(), "m2": m.m2.ravel().tolist()}


_ARROW = pa.schema([("part", pa.int32()), ("slot", pa.int32()), ("n", pa.float64()), ("mean", pa.list_(pa.float64())), ("m2", pa.list_(pa.float64()))])


def moments_by_part(df: DataFrame, columns: list[str], part: Column) -> dict[int, Moments]:
    """The moments of ``columns`` for every value of the small integer ``part``; rows of a null part are left out."""
    width = len(columns)
    rows = training_rows(df, columns).where(part.isNotNull()).select(part.cast("int").alias("part"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])

    def summarise(batches):
        held: dict = {}
        for batch in batches:
            parts = batch.column(0).to_numpy(zero_copy_only=False)
            values = np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(width)])
            for k in np.unique(parts).tolist():
                held[k] = held.get(k, Moments.empty(width)) + Moments.of(values[parts == k])
        if held:
            slot = hash(tuple(held[min(held)].mean.tolist())) % FAN_IN
            yield pa.RecordBatch.from_pylist([_row(k, slot, m) for k, m in held.items()], schema=_ARROW)

    def merge(table):
        total = Moments.empty(width)
        for r in table.sort_by([("n", "ascending")]).to_pylist():
            total = total + Moments(r["n"], np.array(r["mean"]), np.array(r["m2"]).reshape(width, width))
        return pa.Table.from_pylist([_row(table.column("part")[0].as_py(), 0, total)], schema=_ARROW)

    partial = rows.mapInArrow(summarise, _PART)
    merged = partial.groupBy("part", "slot").applyInArrow(merge, _PART).groupBy("part").applyInArrow(merge, _PART)
    return {r["part"]: Moments(r["n"], np.array(r["mean"]), np.array(r["m2"]).reshape(width, width)) for r in merged.collect()}


def time_folds(df: DataFrame, columns: list[str], folds: int = 3, date: str = "date") -> list[Moments]:
    """Moments of ``folds + 1`` successive stretches of time that hold about equally many usable rows."""
    rows = training_rows(df, columns)
    day = F.unix_date(date).cast("double")
    shares = F.array(*[F.lit(i / (folds + 1)) for i in range(1, folds + 1)])
    cuts = rows.groupBy(day.alias("d")).agg(F.count(F.lit(1)).alias("n")).agg(F.percentile("d", shares, F.col("n"))).first()[0]
    if cuts is None:
        return [Moments.empty(len(columns))] * (folds + 1)
    part = F.lit(0)
    for cut in cuts:
        part = part + (day >= F.lit(float(cut))).cast("int")
    found = moments_by_part(rows, columns, part)
    return [found.get(i, Moments.empty(len(columns))) for i in range(folds + 1)]


def search_linear(df: DataFrame, features: list[str], label: str, grid: dict[str, list], folds: int = 3) -> DataFrame:
    """Mean squared error of every model of the grid over expanding, time-ordered folds: two passes for the whole grid.

    ``grid`` maps settings of ``fit_linear`` to their options. Fold i trains on all stretches before stretch i.
    """
    stretches = time_folds(df, [*features, label], folds)
    results = []
    for values in product(*grid.values()):
        settings = dict(zip(grid, values))
        train = stretches[0]
        for i, check in enumerate(stretches[1:]):
            if train.n > 1 and check.n:
                results.append((", ".join(f"{k}={v}" for k, v in settings.items()), i, int(train.n), int(check.n), fit_linear(train, **settings).mse(check)))
            train = train + check
    return df.sparkSession.createDataFrame(results, "settings string, fold int, train_rows long, test_rows long, mse double")


def linear_per_symbol(df: DataFrame, features: list[str], label: str, models: dict[str, dict], min_rows: int = 100, train: float = 0.8) -> DataFrame:
    """Several models for each symbol from one summary of its first rows, scored on the rest.

    A group is one series at the daily grain, bounded by the calendar; the moments make each further model free of charge.
    """
    columns = [*features, label]
    rows = training_rows(df, columns).select("symbol", "date", *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    key = dict(rows.dtypes)["symbol"]
    out = f"symbol {key}, model string, train_rows long, test_rows long, intercept double, coefficients array<double>, mse double"

    def one(table):
        table = table.sort_by([("date", "ascending")])
        values = np.column_stack([table.column(f"c{i}").to_numpy() for i in range(len(columns))])
        cut = int(len(values) * train)
        found = []
        if len(values) >= min_rows and 1 < cut < len(values):
            before, after = Moments.of(values[:cut]), Moments.of(values[cut:])
            for name, settings in models.items():
                model = fit_linear(before, **settings)
                found.append({"symbol": table.column("symbol")[0].as_py(), "model": name, "train_rows": cut, "test_rows": len(values) - cut,
                              "intercept": model.intercept, "coefficients": model.coefficients.tolist(), "mse": model.mse(after)})
        return pa.Table.from_pylist(found, schema=pa.schema([
            ("symbol", table.schema.field("symbol").type), ("model", pa.string()), ("train_rows", pa.int64()), ("test_rows", pa.int64()),
            ("intercept", pa.float64()), ("coefficients", pa.list_(pa.float64())), ("mse", pa.float64())]))

    return rows.groupBy("symbol").applyInArrow(one, out)
