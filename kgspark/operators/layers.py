"""Relational layers as distributed matrix products: weights are tables, never literals of a plan.

weights: relation, block, row, values: row `row` of the matrix that a
relation's vectors are multiplied by (of their block, in block-diagonal form);
values is as wide as the result. features: node, vector (array<double>); edges: src,
dst, etype, and weight where edges weigh unlike. Vectors shorter than a
matrix has rows end in zeros; what is beyond its rows, and rows that the
table lacks, count nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions.vectors import element_mean

#: Tasks among which the vectors of a relation are dealt; each holds that relation's matrix of a block.
DEALT = 16


def _stacked(column: pa.ListArray, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    if len(column) and (sizes == width).all():
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    for row, own in zip(out, column.to_pylist(), strict=True):
        own = (own or [])[:width]
        row[: len(own)] = own
    return out


def multiplied(messages: DataFrame, weights: DataFrame) -> DataFrame:
    """(node, block, vector): messages(node, relation, block, vector), each times its relation's and block's matrix, summed by node and block.

    Matrices and vectors meet by relation and block: a task reads the matrix
    first and then multiplies batches of vectors by it. A hot relation is dealt
    to DEALT tasks. Messages of relations without weights give nothing.
    """
    kind = messages.schema["node"].dataType.simpleString()
    key = [F.col("relation").cast("string").alias("relation"), F.col("block").cast("int").alias("block")]
    doubles = lambda c: F.transform(c, lambda x: x.cast("double")).alias("vector")
    own = weights.select(*key, F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("dealt"), F.col("row").cast("int").alias("row"), F.lit(None).cast(kind).alias("node"), doubles("values"))
    sent = messages.select(*key, F.pmod(F.xxhash64("node"), F.lit(DEALT)).cast("int").alias("dealt"), F.lit(None).cast("int").alias("row"), "node", doubles("vector"))
    met = own.unionByName(sent).repartition("relation", "block", "dealt").sortWithinPartitions("relation", "block", "dealt", F.col("row").asc_nulls_last())

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, matrix = None, [], None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("relation", "block", "dealt")), (r is not None for r in batch.column("row").to_pylist()), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                some = batch.slice(a, b - a)
                if keys[a][:3] != key:
                    key, rows, matrix = keys[a][:3], [], None
                if keys[a][3]:
                    rows += zip(some.column("row").to_pylist(), some.column("vector").to_pylist(), strict=True)
                    continue
                if not rows:
                    continue
                if matrix is None:
                    matrix = np.zeros((max(r for r, _ in rows) + 1, max(len(v) for _, v in rows)))
                    for r, v in rows:
                        matrix[r, : len(v)] = v
                out = _stacked(some.column("vector"), len(matrix)) @ matrix
                ends = np.arange(len(out) + 1, dtype=np.int32) * matrix.shape[1]
                columns = [some.column("node"), pa.array([key[1]] * len(out), pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "block", "vector"])

    return element_mean(met.mapInArrow(stream, f"node {kind}, block int, vector array<double>"), ["node", "block"], "vector", how="sum")


def seeded_weights(spark: SparkSession, sizes: dict[str, tuple[int, int]], seed: int = 0) -> DataFrame:
    """weights that are not learned: a rows x columns matrix per relation, uniform within the usual bound of its size, by a hash of their places."""
    named = spark.createDataFrame([(r, n, m) for r, (n, m) in sizes.items()], "relation string, n int, m int")  # one line a relation
    rows = named.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("row"))
    unit = lambda k: F.pmod(F.xxhash64(F.lit(seed), "relation", "row", k), F.lit(2_000_001)) / 1_000_000.0 - 1.0
    values = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda k: unit(k) * F.sqrt(6.0 / (F.col("n") + F.col("m"))))
    return rows.select("relation", F.lit(0).alias("block"), "row", values.alias("values"))


def messages(edges: DataFrame, features: DataFrame, how: str = "avg") -> DataFrame:
    """(node, relation, vector): the mean or sum of what reaches a node by a relation; an edge's weight, if there is one, multiplies what it sends."""
    sent = edges.join(features.select(F.col("node").alias("src"), "vector"), "src")
    if "weight" in edges.columns:
        sent = sent.withColumn("vector", F.transform("vector", lambda x: x * F.col("weight")))
    return element_mean(sent.select(F.col("dst").alias("node"), F.col("etype").cast("string").alias("relation"), "vector"), ["node", "relation"], "vector", how=how)


def _whole(blocks: DataFrame) -> DataFrame:
    """(node, vector): a node's blocks, one behind the other."""
    listed = F.array_sort(F.collect_list(F.struct("block", "vector")))
    return blocks.groupBy("node").agg(F.flatten(F.transform(listed, lambda b: b["vector"])).alias("vector"))


def relational_layer(
    edges: DataFrame, features: DataFrame, weights: DataFrame, root: DataFrame | None = None, bias: DataFrame | None = None, comp: DataFrame | None = None, blocks: int | None = None, how: str = "avg"
) -> DataFrame:
    """(node, vector): root x own + sum over relations of their weights x what reaches the node by them + bias, for each node of features.

    Basis form: with comp(relation, basis, c) the weights' relations are the
    bases, and a relation's matrix is the sum of c x basis. The messages are mixed
    by c first, so there are as many products as bases, not relations. Block
    form: with blocks, vectors are cut into so many equal parts, each with the
    matrix of its block. root(row, values) and bias(place, value) may be left out.
    A node that nothing reaches has root and bias alone, one without any of the
    three an empty vector.
    """
    sent = messages(edges, features, how)
    if comp is not None:
        mixed = sent.join(comp.select(F.col("relation").cast("string").alias("relation"), F.col("basis").cast("string").alias("basis"), "c"), "relation")
        mixed = mixed.select("node", F.col("basis").alias("relation"), F.transform("vector", lambda x: x * F.col("c")).alias("vector"))
        sent = element_mean(mixed, ["node", "relation"], "vector", how="sum")
    if blocks:
        part = F.ceil(F.size("vector") / blocks).cast("int")
        cut = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: F.struct(b.alias("block"), F.slice("vector", b * part + 1, part).alias("vector")))
        sent = sent.select("node", "relation", F.explode(cut).alias("b")).select("node", "relation", "b.block", "b.vector")
    else:
        sent = sent.withColumn("block", F.lit(0))
    parts = _whole(multiplied(sent, weights))
    if root is not None:
        own = features.select("node", F.lit("root").alias("relation"), F.lit(0).alias("block"), "vector")
        parts = parts.unionByName(multiplied(own, root.select(F.lit("root").alias("relation"), F.lit(0).alias("block"), "row", "values")).select("node", "vector"))
    if bias is not None:
        line = bias.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"].cast("double")).alias("vector"))  # one row
        parts = parts.unionByName(features.select("node").crossJoin(F.broadcast(line)))
    summed = element_mean(parts, ["node"], "vector", how="sum")
    return features.select("node").join(summed, "node", "left").select("node", F.coalesce("vector", F.array().cast("array<double>")).alias("vector"))


def mixed_embedding(nodes: DataFrame, weights: DataFrame, width: int, seed: int = 0) -> DataFrame:
    """(node, vector) of nodes(node, etype, vector): a featured node's vector times its type's matrix; a seeded row for one without a vector or a matrix."""
    own = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.pmod(F.xxhash64(F.lit(seed), F.col("node"), k), F.lit(2_000_001)) / 1_000_000.0 - 1.0)
    sent = nodes.where(F.col("vector").isNotNull()).select("node", F.col("etype").alias("relation"), F.lit(0).alias("block"), "vector")
    made = multiplied(sent, weights).select(F.col("node").alias("_node"), F.col("vector").alias("_made"))
    return nodes.join(made, F.col("node") == F.col("_node"), "left").select("node", F.coalesce("_made", own).alias("vector"))


def dense(features: DataFrame, weights: DataFrame, bias: DataFrame, relu: bool = True) -> DataFrame:
    """(node, vector): one layer of a perceptron; weights(row, values), bias(place, value)."""
    none = features.sparkSession.createDataFrame([], "src long, dst long, etype string").select(*(F.col(c).cast(features.schema["node"].dataType).alias(c) for c in ("src", "dst")), "etype")
    out = relational_layer(none, features, weights.select(F.lit("none").alias("relation"), F.lit(0).alias("block"), "row", "values"), weights, bias)
    return out.select("node", F.transform("vector", lambda x: F.greatest(x, F.lit(0.0))).alias("vector")) if relu else out
