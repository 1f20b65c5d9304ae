"""Linear heads fitted on Spark: logistic regression of many labels at once by Newton's method.

rows: vector (array<double>), ys (array<double>: a place per label; null where the
row says nothing of the label), and weight, if rows weigh unlike. Each pass over
the rows sums gradients, or products of the Hessians with one direction a label,
within tasks; what leaves a task, and what the driver holds, is labels x width
numbers, as large as the model, whatever the number of rows. Newton's directions come
from conjugate gradients, for all labels in the same passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.session import written

ROUNDS, STEPS, TOLERANCE = 30, 60, 1e-7
#: Rows that a task multiplies at a time.
SLICE = 4096


def pair_rows(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """pairs(arm1, arm2, ..) with vector: the two arms' vectors, one behind the other; pairs with an unknown arm are left out."""
    side = lambda k: features.select(F.col("node").alias(f"arm{k}"), F.col("vector").alias(f"_v{k}"))
    return pairs.join(side(1), "arm1").join(side(2), "arm2").withColumn("vector", F.concat("_v1", "_v2")).drop("_v1", "_v2")


def _matrix(column: pa.ListArray, width: int, missing: float) -> np.ndarray:
    out = np.full((len(column), width), missing)
    for row, own in zip(out, column.to_pylist(), strict=True):
        if own is not None:
            own = own[:width]
            row[: len(own)] = [missing if x is None else x for x in own]
    return out


def positive_weights(rows: DataFrame, labels: int) -> np.ndarray:
    """The root of each label's negatives a positive, by weight; 1 where it has no positive or no negative."""
    place = rows.select("weight", F.posexplode("ys").alias("k", "y")).where(F.col("y").isNotNull() & (F.col("k") < labels))
    out = np.ones(labels)
    for r in place.groupBy("k").agg(F.sum(F.col("weight") * F.col("y")).alias("p"), F.sum(F.col("weight") * (1 - F.col("y"))).alias("n")).collect():  # a line a label
        out[r.k] = (r.n / r.p) ** 0.5 if r.p and r.n else 1.0
    return out


def _summed(rows: DataFrame, labels: int, width: int, what: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of what(x, ys, weights): labels x columns, by tasks and then by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                x = np.concatenate([_matrix(batch.column("vector"), width - 1, 0.0), np.ones((batch.num_rows, 1))], 1)
                part = what(x, _matrix(batch.column("ys"), labels, np.nan), batch.column("weight").to_numpy(zero_copy_only=False))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(labels, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["label", "sums"])

    parts = rows.mapInArrow(run, "label int, sums array<double>").select("label", F.posexplode("sums").alias("place", "x")).groupBy("label", "place").agg(F.sum("x").alias("x"))
    found = parts.collect()  # labels x width numbers
    out = np.zeros((labels, 1 + max((r.place for r in found), default=width - 1)))
    for r in found:
        out[r.label, r.place] = r.x
    return out


def _chances(x: np.ndarray, model: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ model.T, -700, 700)))


def _loss(model: np.ndarray, positive: np.ndarray):
    """Of x, ys, weights: each label's gradient and, in the last column, its loss."""

    def at(x, ys, weights):
        p, known = _chances(x, model), ~np.isnan(ys)
        y = np.where(known, ys, 0.0)
        c = np.where(known, weights[:, None] * np.where(y > 0, positive[None], 1.0), 0.0)
        loss = -(c * (y * np.log(np.maximum(p, 1e-300)) + (1 - y) * np.log(np.maximum(1 - p, 1e-300)))).sum(0)
        return np.concatenate([(c * (p - y)).T @ x, loss[:, None]], 1)

    return at


def _curvature(model: np.ndarray, positive: np.ndarray, direction: np.ndarray):
    """Of x, ys, weights: each label's Hessian times its direction."""

    def at(x, ys, weights):
        p, known = _chances(x, model), ~np.isnan(ys)
        c = np.where(known, weights[:, None] * np.where(ys > 0, positive[None], 1.0), 0.0)
        return (c * p * (1 - p) * (x @ direction.T)).T @ x

    return at


def fit(rows: DataFrame, labels: int, width: int, l2: float = 1.0, balanced: bool = True, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """The model, labels x (width + 1), the intercept last: what minimises each label's weighed log loss + l2 / 2 x |coefficients|^2.

    With balanced, a label's positives weigh as many times as the root of its negatives
    a positive. Null vectors are left out; labels that no row speaks of stay at
    zero, and so does all of a table without rows. The intercept isn't held back by l2.
    """
    weight = F.col("weight").cast("double") if "weight" in rows.columns else F.lit(1.0)
    doubles = lambda c: F.transform(c, lambda x: x.cast("double")).alias(c)
    rows = written(rows.where(F.col("vector").isNotNull()).select(doubles("vector"), doubles("ys"), F.coalesce(weight, F.lit(0.0)).alias("weight")), "heads-rows")
    positive = positive_weights(rows, labels) if balanced else np.ones(labels)
    held = np.full(width + 1, l2)
    held[-1] = 0.0

    def state(model):
        out = _summed(rows, labels, width + 1, _loss(model, positive))
        return (out[:, :-1] + held * model, out[:, -1] + 0.5 * (held * model**2).sum(1)) if out.shape[1] == width + 2 else (np.zeros_like(model), np.zeros(labels))

    model = np.zeros((labels, width + 1))
    gradient, loss = state(model)
    scale = np.maximum(1.0, np.abs(gradient).max(1))
    for _ in range(rounds):
        open_ = np.abs(gradient).max(1) > tolerance * scale
        if not open_.any():
            break
        # Conjugate gradients for H d = -g, one system a label, in the same passes.
        step, left = np.zeros_like(model), np.where(open_[:, None], -gradient, 0.0)
        way, size = left.copy(), (left**2).sum(1)
        goal = size * 1e-8
        for _ in range(STEPS):
            if not (size > goal).any():
                break
            bent = _summed(rows, labels, width + 1, _curvature(model, positive, way)) + held * way + 1e-12 * way
            along = (way * bent).sum(1)
            alpha = np.where((size > goal) & (along > 0), size / np.where(along > 0, along, 1.0), 0.0)
            step, left = step + alpha[:, None] * way, left - alpha[:, None] * bent
            new = (left**2).sum(1)
            way, size = left + np.where(size > 0, new / np.where(size > 0, size, 1.0), 0.0)[:, None] * way, new
        # Halve the steps of labels whose loss would grow.
        share = np.where(open_, 1.0, 0.0)
        for _ in range(20):
            tried = model + share[:, None] * step
            next_gradient, next_loss = state(tried)
            worse = (next_loss > loss + 1e-9 * np.abs(loss)) & (share > 0)
            if not worse.any():
                break
            share = np.where(worse, share / 2, share)
        model, gradient, loss = tried, next_gradient, next_loss
    return model


def scored(rows: DataFrame, model: np.ndarray, key: str) -> DataFrame:
    """(key, label, score, p) of every label for each row(key, vector); a null vector is one of zeros."""
    labels, width = model.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                x = np.concatenate([_matrix(batch.column("vector"), width - 1, 0.0), np.ones((batch.num_rows, 1))], 1)
                who = pa.array(np.repeat(np.arange(batch.num_rows), labels))
                columns = [batch.column("key").take(who), pa.array(np.tile(np.arange(labels, dtype=np.int32), batch.num_rows)), pa.array((x @ model.T).ravel()), pa.array(_chances(x, model).ravel())]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "label", "score", "p"])

    doubles = F.transform("vector", lambda x: x.cast("double")).alias("vector")
    return rows.select(F.col(key).alias("key"), doubles).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, label int, score double, p double")
