"""Multi-head attention over typed graphs, with projections as distributed products of weight tables.

A softmax within a segment needs two partial aggregates, the segment's largest
score and then the sums over it; no task holds a node's edges together, so a
hub is as any node. Weights are tables as in layers; a matrix's row behind its
input's last place is its bias (inputs end in a 1). features: node, ntype (for
typed_attention), vector; edges: src, dst, etype.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions.features import sigmoid
from kgspark.functions.vectors import dot, element_mean
from kgspark.operators.layers import multiplied


def attended(scored: DataFrame, within: list[str], keys: list[str]) -> DataFrame:
    """(keys, vector): scored(within, keys, score, vector): the vectors summed by keys, each weighed by the softmax of its score within `within`."""
    segment = scored.groupBy(*within).agg(F.max("score").alias("_most"))
    segment = segment.select(*[F.col(c).alias(f"_w{k}") for k, c in enumerate(within)], "_most")
    met = scored.join(segment, _all([F.col(c).eqNullSafe(F.col(f"_w{k}")) for k, c in enumerate(within)]))
    weighed = met.withColumn("_e", F.exp(F.col("score") - F.col("_most"))).drop("_most")
    # One aggregate gives the weighed sums and the sum of weights, in the place behind the last.
    parts = weighed.select(*dict.fromkeys([*within, *keys]), F.transform(F.concat("vector", F.array(F.lit(1.0))), lambda x: x * F.col("_e")).alias("vector"))
    sums = element_mean(parts, list(dict.fromkeys([*within, *keys])), "vector", how="sum")
    share = F.transform(F.slice("vector", F.lit(1), F.size("vector") - 1), lambda x: x / F.element_at("vector", -1))
    return element_mean(sums.select(*keys, share.alias("vector")), keys, "vector", how="sum")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _project(features: DataFrame, relation: Column, weights: DataFrame, vector: str = "vector") -> DataFrame:
    """(node, vector): each vector, a 1 behind it, times its relation's matrix."""
    sent = features.select("node", relation.cast("string").alias("relation"), F.lit(0).alias("block"), F.concat(vector, F.array(F.lit(1.0))).alias("vector"))
    return multiplied(sent, weights).select("node", "vector")


def _heads(rows: DataFrame, key: str, heads: int, name: str) -> DataFrame:
    """(key, head, name): a row's vector cut into as many parts as there are heads."""
    size = (F.size("vector") / heads).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.lit(heads - 1)), lambda h: F.struct(h.alias("head"), F.slice("vector", h * size + 1, size).alias(name)))
    return rows.select(key, F.explode(cut).alias("c")).select(key, "c.head", f"c.{name}")


def _joined(rows: DataFrame) -> DataFrame:
    """(node, vector) of (node, head, vector), by head."""
    listed = F.array_sort(F.collect_list(F.struct("head", "vector")))  # one entry a head
    return rows.groupBy("node").agg(F.flatten(F.transform(listed, lambda x: x["vector"])).alias("vector"))


def _summed(features: DataFrame, parts: list[DataFrame]) -> DataFrame:
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    sums = element_mean(every, ["node"], "vector", how="sum")
    return features.select("node").join(sums, "node", "left").select("node", F.coalesce("vector", F.array().cast("array<double>")).alias("vector"))


def multi_head(
    edges: DataFrame, features: DataFrame, left: DataFrame, right: DataFrame, weights: DataFrame, heads: int, how: str = "dot", scaled: bool = False,
    attention: DataFrame | None = None, slope: float = 0.2, concat: bool = True, root: DataFrame | None = None, within: tuple = ("dst", "etype"),
) -> DataFrame:
    """(node, vector): for each relation the messages weights[relation] x source, weighed by a softmax per node, relation and head; summed over relations, with root x own.

    A score is the product of left x source and right x target (left, right:
    row, values), over sqrt of a head's width if scaled; or, additive, the leaky
    (slope) sum of the two's products with attention(head, side l or r, values), where l
    goes with the target. Heads stand one behind the other, or are averaged.
    weights: relation, block 0, row, values. Nodes without in-edges have root's part alone.
    """
    one = lambda w: w.select(F.lit("all").alias("relation"), F.lit(0).alias("block"), "row", "values")
    k = _heads(_project(features, F.lit("all"), one(left)), "node", heads, "k").withColumnRenamed("node", "src")
    q = _heads(_project(features, F.lit("all"), one(right)), "node", heads, "q").withColumnRenamed("node", "dst")
    sent = edges.select("src", "etype").distinct().join(features.select(F.col("node").alias("src"), "vector"), "src")
    sent = sent.select(F.struct("src", "etype").alias("node"), F.col("etype").cast("string").alias("relation"), F.lit(0).alias("block"), "vector")
    v = _heads(multiplied(sent, weights), "node", heads, "v").select("node.src", "node.etype", "head", "v")
    met = edges.select("src", "dst", "etype").join(v, ["src", "etype"]).join(k, ["src", "head"]).join(q, ["dst", "head"])
    if how == "additive":
        side = lambda s: attention.where(F.col("side") == s).select("head", F.col("values").alias(f"_{s}"))
        met = met.join(F.broadcast(side("l")), "head").join(F.broadcast(side("r")), "head")  # a row a head
        score = dot(F.col("q"), F.col("_l")) + dot(F.col("k"), F.col("_r"))
        score = F.when(score < 0, score * slope).otherwise(score)
    else:
        score = dot(F.col("q"), F.col("k"))
        score = score / F.sqrt(F.size("q").cast("double")) if scaled else score
    scored = met.select("dst", "etype", "head", score.alias("score"), F.col("v").alias("vector"))
    parts = attended(scored, [*within, "head"], ["dst", "head"]).withColumnRenamed("dst", "node")
    parts = _joined(parts) if concat else element_mean(parts, ["node"], "vector")
    more = [] if root is None else [_project(features, F.lit("all"), one(root))]
    return _summed(features, [parts.select("node", "vector"), *more])


def gelu(vector: Column) -> Column:
    """x times the normal distribution's share below x, by place."""

    @F.pandas_udf("array<double>")
    def by_batch(vectors: pd.Series) -> pd.Series:
        erf = np.vectorize(math.erf, otypes=[float])
        return vectors.map(lambda v: 0.5 * np.asarray(v) * (1 + erf(np.asarray(v) / math.sqrt(2))) if len(v) else v)

    return by_batch(vector)


def layer_norm(vector: Column, gain: Column, shift: Column, epsilon: float = 1e-5) -> Column:
    """(x - mean) / sqrt(variance + epsilon) by place, times gain, plus shift."""
    n = F.size(vector).cast("double")
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    mean = total(vector) / n
    centred = F.transform(vector, lambda x: x - mean)
    scale = F.sqrt(total(F.transform(centred, lambda x: x * x)) / n + epsilon)
    scaled = F.zip_with(centred, gain, lambda x, g: x / scale * g)
    return F.zip_with(scaled, shift, lambda x, s: x + s)


def typed_attention(
    edges: DataFrame, features: DataFrame, heads: int, keys: DataFrame, queries: DataFrame, values: DataFrame, outs: DataFrame, att: DataFrame, msg: DataFrame, priority: DataFrame, skip: DataFrame, norms: DataFrame | None = None
) -> DataFrame:
    """(node, vector): heterogeneous attention over all of a node's in-edges, gated against its own vector.

    keys, queries, values, outs: weights by node type (relation = ntype); att,
    msg: by edge type and head (block), square; priority(relation, head, value);
    skip(ntype, value), a gate before the sigmoid; norms(ntype, gain, shift: arrays)
    for a norm behind the gate. Key and message of a source are worked out once
    per edge type it sends by, not per edge. A node without in-edges has its
    output's bias, gated like others.
    """
    ntype = F.col("ntype")
    project = lambda w: _project(features, ntype, w)
    sources = edges.select("src", "etype").distinct()

    def sent(weights: DataFrame, by: DataFrame, name: str) -> DataFrame:
        own = _heads(project(weights), "node", heads, "vector").withColumnRenamed("node", "src")
        rows = sources.join(own, "src").select(F.struct("src", "etype").alias("node"), F.col("etype").cast("string").alias("relation"), F.col("head").alias("block"), "vector")
        return multiplied(rows, by).select("node.src", "node.etype", F.col("block").alias("head"), F.col("vector").alias(name))

    q = _heads(project(queries), "node", heads, "q").withColumnRenamed("node", "dst")
    known = priority.select(F.col("relation").cast("string").alias("_r"), F.col("head").cast("int").alias("_h"), F.col("value").alias("_priority"))
    met = edges.select("src", "dst", "etype").join(sent(keys, att, "k"), ["src", "etype"]).join(sent(values, msg, "v"), ["src", "etype", "head"]).join(q, ["dst", "head"])
    met = met.join(known, (F.col("etype").cast("string") == F.col("_r")) & (F.col("head") == F.col("_h")))
    score = dot(F.col("q"), F.col("k")) * F.col("_priority") / F.sqrt(F.size("q").cast("double"))
    parts = _joined(attended(met.select("dst", "head", score.alias("score"), F.col("v").alias("vector")), ["dst", "head"], ["dst", "head"]).withColumnRenamed("dst", "node"))
    own = features.join(parts.withColumnRenamed("vector", "_sum"), "node", "left").withColumn("_sum", gelu(F.coalesce("_sum", F.array_repeat(F.lit(0.0), F.size("vector")))))
    moved = _project(own, ntype, outs, "_sum").withColumnRenamed("vector", "_moved")
    gate = skip.select(F.col("ntype").alias("_t"), sigmoid(F.col("value")).alias("_gate"))
    met = own.join(moved, "node").join(gate, ntype == F.col("_t"))
    mixed = F.zip_with("_moved", "vector", lambda m, x: m * F.col("_gate") + x * (1 - F.col("_gate")))
    if norms is None:
        return met.select("node", mixed.alias("vector"))
    met = met.join(norms.select(F.col("ntype").alias("_n"), "gain", "shift"), ntype == F.col("_n")).withColumn("_mixed", mixed)
    return met.select("node", layer_norm(F.col("_mixed"), F.col("gain"), F.col("shift")).alias("vector"))
