"""Direct multi-step linear regression from distributed, mergeable moments.

A fit needs only the number, the means and the centered products of its columns. Tasks take them of
the rows they read, per series (or over all), they are merged pairwise, and a small system is solved
per series; rows of the feature table never gather anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.config import lag_names, quoted, target_names
from tidecast.operators.metrics import prediction_name

# Eigenvalues below this share of the largest count as zero in the solve.
RCOND = 1e-10
# Deviations below this share of a mean are rounding, not variation.
NOISE = 64 * 2.220446049250313e-16
# Series whose moments a task holds, or solves, at once.
HELD_SERIES = 2_000


def sufficient_statistics(frame: DataFrame, keys, x: list[str], y: list[str]) -> DataFrame:
    """The raw sums of a fit, as other engines state them; fits themselves use moments, which lose no digits far from zero.

    (keys, term, s): s[0] = Σ w and s[j] = Σ w·x_j for w = 1 (term 0), every x, then every y.

    Each row is spread over its terms and summed at once; the partial aggregate keeps one row
    per (series, term) and task, so a hot series costs no more shuffle than a cold one.
    """
    xs = [f"__x{j}" for j in range(1, len(x) + 1)]
    columns = [F.col(quoted(c)).cast("double") for c in x]
    terms = F.array(F.lit(1.0), *columns, *[F.col(quoted(c)).cast("double") for c in y])
    spread = frame.select(
        *keys, *[c.alias(a) for c, a in zip(columns, xs)], F.posexplode(terms).alias("term", "w"))
    sums = spread.groupBy(*keys, "term").agg(
        F.sum("w").alias("__s0"), *[F.sum(F.col("w") * F.col(a)).alias(f"__s{j}") for j, a in enumerate(xs, 1)])
    return sums.select(*keys, "term", F.array("__s0", *[f"__s{j}" for j in range(1, len(x) + 1)]).alias("s"))


class Moments:
    """Number, means and centered products of the columns x and y of some rows; two of them merge into one.

    Products are those of deviations from the rows' own means, so numbers that lie close together far
    from zero keep their variation, and merging adds only what the means differ by.
    """

    def __init__(self, n: int, mean: np.ndarray, products: np.ndarray):
        self.n, self.mean, self.products = n, mean, products

    @staticmethod
    def of(rows: np.ndarray, n_x: int) -> Moments:
        mean = rows.mean(axis=0)
        off = rows - mean
        # What rounding left in the mean is taken out of the products.
        rest = off.sum(axis=0)
        return Moments(len(rows), mean + rest / len(rows), off.T @ off[:, :n_x] - np.outer(rest, rest[:n_x]) / len(rows))

    def merged(self, other: Moments) -> Moments:
        n, apart = self.n + other.n, other.mean - self.mean
        n_x = self.products.shape[1]
        between = np.outer(apart, apart[:n_x]) * (self.n * (other.n / n))
        return Moments(n, self.mean + apart * (other.n / n), self.products + other.products + between)

    def packed(self) -> list[float]:
        return [float(self.n), *self.mean.tolist(), *self.products.ravel().tolist()]

    @staticmethod
    def unpacked(values: np.ndarray, n_x: int) -> Moments:
        width = (len(values) - 1) // (1 + n_x)
        return Moments(int(values[0]), values[1:1 + width], values[1 + width:].reshape(width, n_x))


def partial_moments(frame: DataFrame, keys, x: list[str], y: list[str]) -> DataFrame:
    """(keys, moments): the moments of the rows of each series that a task has seen; rows with a null or NaN are left out.

    A task keeps one entry per series and hands them on once it has HELD_SERIES, so its memory is bounded
    and a hot series moves as one row per task.
    """
    keys, n_x = list(keys), len(x)
    names = [*x, *y]
    columns = [F.col(quoted(c)).cast("double").alias(f"__{k}") for k, c in enumerate(names)]
    schema = T.StructType([frame.schema[k] for k in keys] + [T.StructField("moments", T.ArrayType(T.DoubleType()))])

    def rows_of(held: dict) -> pd.DataFrame:
        out = pd.DataFrame(list(held), columns=keys) if keys else pd.DataFrame(index=range(len(held)))
        out["moments"] = [m.packed() for m in held.values()]
        return out

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, Moments] = {}
        for batch in batches:
            values = batch.iloc[:, len(keys):].to_numpy(float)
            known = ~np.isnan(values).any(axis=1)
            values, batch = values[known], batch[known]
            groups = batch.groupby(keys, sort=False, dropna=False).indices if keys else {(): np.arange(len(batch))}
            for key, at in groups.items():
                if len(at):
                    key = key if isinstance(key, tuple) else (key,)
                    found = Moments.of(values[at], n_x)
                    held[key] = held[key].merged(found) if key in held else found
            if len(held) >= HELD_SERIES:
                yield rows_of(held)
                held = {}
        if held:
            yield rows_of(held)

    return frame.select(*keys, *columns).mapInPandas(sums, schema)


def solve(partials: DataFrame, keys, n_x: int, n_y: int, rcond: float = RCOND) -> DataFrame:
    """(keys, n_rows, intercepts[n_y], weights[n_y][n_x]), one row per series, from partial_moments.

    The partial rows of a series meet in one task and are merged as they come, so no group is held whole.
    The pseudo-inverse picks the least-norm solution, so a constant or too short series still gets one.
    """
    keys = list(keys)
    schema = T.StructType([partials.schema[k] for k in keys] + [
        T.StructField("n_rows", T.LongType()),
        T.StructField("intercepts", T.ArrayType(T.DoubleType())),
        T.StructField("weights", T.ArrayType(T.ArrayType(T.DoubleType()))),
    ])

    def solve_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, Moments] = {}
        for batch in batches:
            for *key, values in batch.itertuples(index=False, name=None):
                found = Moments.unpacked(np.asarray(values, float), n_x)
                held[tuple(key)] = held[tuple(key)].merged(found) if tuple(key) in held else found
        series = list(held.items())
        for start in range(0, len(series), HELD_SERIES):
            part = series[start:start + HELD_SERIES]
            n = np.array([m.n for _, m in part])
            mean, products = np.array([m.mean for _, m in part]), np.array([m.products for _, m in part])
            gram, cross = products[:, :n_x], products[:, n_x:]           # x·x and y·x
            # Directions that are zero, or no larger than what rounding leaves of a constant.
            values, vectors = np.linalg.eigh(gram)
            noise = n * (NOISE * np.abs(mean[:, :n_x]).max(axis=1)) ** 2
            floor = np.maximum(rcond * values[:, -1], noise)[:, None]
            inverse = np.where(values > floor, 1.0 / np.where(values > floor, values, 1.0), 0.0)
            weights = cross @ (vectors * inverse[:, None, :]) @ vectors.transpose(0, 2, 1)
            intercepts = mean[:, n_x:] - np.einsum("shx,sx->sh", weights, mean[:, :n_x])
            out = pd.DataFrame([k for k, _ in part], columns=keys) if keys else pd.DataFrame(index=range(len(part)))
            out["n_rows"] = n.astype("int64")
            out["intercepts"] = list(intercepts)
            out["weights"] = [list(w) for w in weights]
            yield out

    return (partials.repartition(*keys) if keys else partials.coalesce(1)).mapInPandas(solve_all, schema)


def fit_linear(frame: DataFrame, keys, x: list[str] | None = None, y: list[str] | None = None) -> DataFrame:
    """One regression per series, or one over all rows with empty ``keys``. Pass training rows."""
    x, y = x or lag_names(), y or target_names()
    return solve(partial_moments(frame, keys, x, y), keys, len(x), len(y))


def _with_model(frame: DataFrame, model: DataFrame, keys) -> DataFrame:
    """Left join on the series key, by which feature tables already are partitioned; a model of all
    rows (no keys) is a single row and comes in as scalars."""
    weights = model.select(*keys, "intercepts", "weights")
    if keys:
        return frame.join(weights, list(keys), "left")
    one = weights.select(F.struct("intercepts", "weights")).scalar()
    return frame.withColumn("__model", one).withColumns({
        c: F.col(f"__model.{c}") for c in ("intercepts", "weights")}).drop("__model")


def score_long(frame: DataFrame, model: DataFrame, keys, keep: list[str], x: list[str] | None = None,
               y: list[str] | None = None) -> DataFrame:
    """(keep…, horizon, y, yhat): one row per cell, the shape that metrics take.

    A row spreads over its horizons before the dot product, so the generated code holds one dot
    product instead of one per horizon and stays small enough to be compiled. Without targets
    (``y`` empty) there is no ``y``. Cells of series without a model have a null ``yhat``; without
    targets such a series has one row with a null horizon.
    """
    x, y = x or lag_names(), target_names() if y is None else y
    parts = ["intercepts", "weights"]
    joined = _with_model(frame, model, keys)
    if y:
        joined = joined.withColumn("__y", F.array(*[F.col(quoted(c)).cast("double") for c in y]))
        parts.append("__y")
        # Arrays of nulls keep the cells of a series without a model.
        none = F.array_repeat(F.lit(None).cast("double"), len(y))
        joined = joined.withColumns({"intercepts": F.coalesce("intercepts", none),
                                     "weights": F.coalesce("weights", F.array_repeat(F.lit(None).cast("array<double>"), len(y)))})
    xs = [F.col(quoted(c)).cast("double").alias(f"__x{j}") for j, c in enumerate(x)]
    spread = joined.select(*keep, *xs, F.posexplode_outer(F.arrays_zip(*parts)).alias("__h", "__c"))
    yhat = F.col("__c.intercepts")
    for j in range(len(x)):
        yhat = yhat + F.col("__c.weights")[j] * F.col(f"__x{j}")
    actual = [F.col("__c.__y").alias("y")] if y else []
    return spread.select(*keep, (F.col("__h") + 1).alias("horizon"), *actual, yhat.alias("yhat"))


def score_linear(frame: DataFrame, model: DataFrame, keys, x: list[str] | None = None, n_y: int = 14) -> DataFrame:
    """Adds yhat_D+1 … yhat_D+n_y; series without a model keep nulls."""
    x = x or lag_names()
    joined = _with_model(frame, model, keys).withColumn(
        "__x", F.array(*[F.col(quoted(c)).cast("double") for c in x]))

    def dot(intercept, weights):
        return F.aggregate(F.zip_with(weights, "__x", lambda a, b: a * b), intercept, lambda total, v: total + v)

    scored = joined.withColumn("__yhat", F.zip_with("intercepts", "weights", dot))
    return scored.withColumns({
        prediction_name(h): F.col("__yhat")[h - 1] for h in range(1, n_y + 1)
    }).drop("intercepts", "weights", "__x", "__yhat")


def coefficient_rows(model: DataFrame, keys, x: list[str] | None = None) -> DataFrame:
    """The model as (keys, horizon, feature, coefficient) rows, the intercept among the features."""
    x = x or lag_names()
    names = F.array(F.lit("intercept"), *[F.lit(c) for c in x])
    per_horizon = model.select(*keys, "intercepts", F.posexplode("weights").alias("h", "w"))
    values = F.concat(F.array(F.col("intercepts")[F.col("h")]), F.col("w"))
    return per_horizon.select(*keys, (F.col("h") + 1).alias("horizon"), F.explode(
        F.arrays_zip(names.alias("feature"), values.alias("coefficient"))).alias("c")).select(*keys, "horizon", "c.*")
