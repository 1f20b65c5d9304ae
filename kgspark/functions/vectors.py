"""Vectors as arrays: scores, norms and means without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))


def norm(v: Column, p: int = 2) -> Column:
    return total(F.transform(_doubles(v), F.abs)) if p == 1 else F.sqrt(dot(v, v))


def l2_normalised(v: Column) -> Column:
    n = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(_doubles(v), lambda x: x / n)


def distmult(h: Column, r: Column, t: Column) -> Column:
    """Sum of h * r * t."""
    return total(F.zip_with(F.zip_with(_doubles(h), _doubles(r), lambda x, y: x * y), _doubles(t), lambda x, y: x * y))


def transe(h: Column, r: Column, t: Column, gamma: float, p: int = 1) -> Column:
    """gamma - |h + r - t|_p."""
    moved = F.zip_with(F.zip_with(_doubles(h), _doubles(r), lambda x, y: x + y), _doubles(t), lambda x, y: x - y)
    return F.lit(gamma) - norm(moved, p)


def augmented(x: Column, r: Column, how: str = "mean") -> Column:
    """A relation's view of x: the sum or mean of x and x * r."""
    return F.zip_with(_doubles(x), _doubles(r), lambda a, b: (a + a * b) / (2.0 if how == "mean" else 1.0))


def padded(v: Column, size: int) -> Column:
    return F.slice(F.concat(_doubles(v), F.array_repeat(F.lit(0.0), size)), 1, size)


def element_mean(rows: DataFrame, keys: list[str], vector: str, out: str = "vector", how: str = "avg") -> DataFrame:
    """Element-wise mean (or sum) of vectors by key; empty and null vectors don't count."""
    agg = {"avg": F.avg, "sum": F.sum}[how]
    long = rows.select(*keys, F.posexplode(_doubles(F.col(vector))).alias("pos", "value"))
    means = long.groupBy(*keys, "pos").agg(agg("value").alias("value"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return means.groupBy(*keys).agg(F.transform(ordered, lambda x: x["value"]).alias(out))
