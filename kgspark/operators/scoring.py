"""Message passing, pooling and losses over long tables: joins and aggregates, no tensors; nearest() alone multiplies blocks of vectors.

features: node, vector (array<double>); edges: src, dst, etype.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.functions.features import log_sigmoid, sigmoid
from kgspark.functions.vectors import dot, element_mean

# Components of a block of vectors, and scores that are held at a time.
BLOCK, TILE = 2**22, 2**21


def neighbour_means(edges: DataFrame, features: DataFrame, how: str = "avg") -> DataFrame:
    """(node, etype, vector): the mean (or sum) of the vectors that reach a node by each relation."""
    sent = edges.join(features.select(F.col("node").alias("src"), "vector"), "src").select(F.col("dst").alias("node"), "etype", "vector")
    return element_mean(sent, ["node", "etype"], "vector", how=how)


def _times_constant(w: float):
    return lambda x: x * w


def relation_concat(edges: DataFrame, features: DataFrame, relations: list[int], width: int, weights: dict[int, float] | None = None) -> DataFrame:
    """(node, vector): a node's own vector and its means by relation, one behind the other in the order given, zeros where there are none.

    With weights the means are summed by weight instead.
    """
    means = neighbour_means(edges, features).groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("etype", F.col("vector").alias("v")))).alias("m"))  # one entry per relation
    joined = features.select("node", F.col("vector").alias("own")).join(means, "node", "left")
    zeros = F.array_repeat(F.lit(0.0), width)
    mean = lambda r: F.coalesce(F.try_element_at("m", F.lit(r)), zeros)
    if weights is None:
        return joined.select("node", F.concat(*map(mean, relations), F.col("own")).alias("vector"))
    total = F.col("own")
    for r in relations:
        scaled = F.transform(mean(r), _times_constant(weights.get(r, 1.0)))
        total = F.zip_with(total, scaled, lambda a, b: a + b)
    return joined.select("node", total.alias("vector"))


def softmax(score: Column, keys: list[str]) -> Column:
    """exp(score) over its sum within the keys, the largest score taken off first."""
    over = W.partitionBy(*keys)
    e = F.exp(score - F.max(score).over(over))
    return e / F.sum(e).over(over)


def attention(edges: DataFrame, features: DataFrame, within: list[str], slope: float | None = None, scaled: bool = True) -> DataFrame:
    """(node, vector): neighbours' vectors weighed by the softmax of their products with the node's own, within `within`.

    within is ["dst", "etype"] for attention inside each relation, ["dst"] over all neighbours.
    """
    to = edges.join(features.select(F.col("node").alias("src"), F.col("vector").alias("k")), "src").join(features.select(F.col("node").alias("dst"), F.col("vector").alias("q")), "dst")
    score = dot(F.col("q"), F.col("k"))
    score = score / F.sqrt(F.size("q")) if scaled else score
    if slope is not None:
        score = F.when(score < 0, slope * score).otherwise(score)
    scored = to.withColumn("_s", score)
    weighed = scored.withColumn("_w", softmax(F.col("_s"), within))
    parts = weighed.select(F.col("dst").alias("node"), F.transform("k", lambda x: x * F.col("_w")).alias("vector"))
    return element_mean(parts, ["node"], "vector", how="sum")


def set_pool(sets: DataFrame, key: str, members: str, features: DataFrame, width: int, how: str = "avg") -> DataFrame:
    """(key, vector): the mean or sum of a set's vectors; zeros for an empty set."""
    each = sets.select(key, F.explode(members).alias("node")).join(features, "node")
    pooled = element_mean(each, [key], "vector", how=how)
    return sets.select(key).distinct().join(pooled, key, "left").select(key, F.coalesce("vector", F.array_repeat(F.lit(0.0), width)).alias("vector"))


def event_scores(arms: DataFrame, events: DataFrame, salt: int = 8) -> DataFrame:
    """(arm, ae, score): w . [h; e] + b of every arm and event: arms(arm, h), events(ae, e, w, b).

    Every arm meets every event, which is what is asked; the events are a
    vocabulary of a fixed size, and are copied to `salt` parts of the arms.
    """
    dealt = arms.withColumn("_salt", F.pmod(F.xxhash64("arm"), F.lit(salt)))
    copied = events.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt - 1).cast("long"))))
    return dealt.join(copied, "_salt").select("arm", "ae", (dot(F.col("w"), F.concat("h", "e")) + F.col("b")).alias("score"))


def residual(x: Column, fx: Column, how: str = "res+") -> Column:
    """x + f(x) with the activation before (res+: f's own) or after (res); plain and dense give f(x)."""
    added = F.zip_with(x, fx, lambda a, b: a + b)
    return {"res+": added, "res": F.transform(added, lambda v: F.greatest(v, F.lit(0.0)))}.get(how, F.transform(fx, lambda v: F.greatest(v, F.lit(0.0))))


def probabilities(scores: DataFrame, score: str = "score") -> DataFrame:
    """scores with p, the sigmoid of the score."""
    return scores.withColumn("p", sigmoid(F.col(score)))


def link_loss(positives: DataFrame, negatives: DataFrame, key: str, temperature: float | None = None) -> DataFrame:
    """(key, loss): -(log sigmoid(s) + weighted mean of log sigmoid(-s')) / 2 of a positive's score and its negatives'.

    With a temperature a negative weighs as the softmax of its score times it
    (self-adversarial sampling), else all weigh the same.
    """
    n = negatives.select(key, F.col("score").alias("_s"))
    weight = F.lit(1.0) / F.count("*").over(W.partitionBy(key)) if temperature is None else softmax(F.col("_s") * temperature, [key])
    lost = n.withColumn("_w", weight).groupBy(key).agg(F.sum(F.col("_w") * log_sigmoid(-F.col("_s"))).alias("_n"))
    return positives.join(lost, key).select(key, (-(log_sigmoid(F.col("score")) + F.col("_n")) / 2).alias("loss"))


def regularisation(relations: DataFrame, vector: str, weight: float) -> DataFrame:
    """One row, loss: weight * mean of the squared entries of all relation vectors."""
    return relations.select(F.explode(F.transform(vector, lambda x: x.cast("double") * x)).alias("x")).agg((weight * F.avg("x")).alias("loss"))


def squared_error(predicted: Column, truth: Column) -> Column:
    return (predicted - truth) * (predicted - truth)


def uncertainty_weighted(losses: list[tuple[Column, Column]]) -> Column:
    """Sum of exp(-s) * loss + s over (loss, s)."""
    parts = [F.exp(-s) * loss + s for loss, s in losses]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def _matrix(vectors: list) -> np.ndarray:
    """Vectors of one length at unit length, summed in order of place as Spark does."""
    m = np.array(vectors, np.float64).reshape(len(vectors), -1)
    n = np.zeros(len(m))
    for j in range(m.shape[1]):
        n += m[:, j] * m[:, j]
    with np.errstate(invalid="ignore"):
        return m / np.maximum(np.sqrt(n), 1e-12)[:, None]


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Doubles rounded half up as F.round does: where that hangs on the last bits, by their decimal notation."""
    near = x * 10.0**digits
    out = np.floor(near + 0.5) / 10.0**digits
    for i in np.flatnonzero(np.abs(near + 0.5 - np.rint(near + 0.5)) < 10.0**digits * 1e-11):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The products of rows of a and b, summed in order of place as Spark does."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def _best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, digits: int):
    """Pieces (query, id, score, place) with the k best rows of ascending ids for each query, its own id apart; ties to smaller ids, NaN above all."""
    scale, step = 10.0**digits, max(1, TILE // max(1, len(ids)))
    low, high = np.searchsorted(ids, q_ids, "left"), np.searchsorted(ids, q_ids, "right")
    rough = [m.astype(np.float32) for m in (q, v)]  # products to within `off`; those that may count are taken again
    off, numbers = 1.2e-7 * (q.shape[1] + 4), np.isfinite(q).all() and np.isfinite(v).all()
    for at in range(0, len(q), step):
        s = rough[0][at : at + step] @ rough[1].T
        if not numbers:
            s[np.isnan(s)] = np.inf
        for i in range(len(s)):
            s[i, low[at + i] : high[at + i]] = -np.inf
        tops, n = s, s.shape[1] // 16
        if n > k:  # the k-th best of 16 columns' best is no more than the k-th best
            tops = s[:, :n].copy()
            for c in range(1, 16):
                np.maximum(tops, s[:, c * n : c * n + n], out=tops)
        kth = np.partition(tops, tops.shape[1] - k, axis=1)[:, tops.shape[1] - k] if tops.shape[1] > k else np.full(len(s), -np.inf)
        i, j = np.nonzero((s >= (kth - 1.001 / scale - 2 * off)[:, None]) & (s > -np.inf))
        score, whole = s[i, j].astype(float), np.flatnonzero(np.isfinite(s[i, j]))
        for some in np.array_split(whole, len(whole) // 2**16 + 1):
            score[some] = half_up(_products(q[at + i[some]], v[j[some]]), digits)
        order = np.lexsort((j, -score, i))
        i, j, score = i[order], j[order], score[order]
        first = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
        yield pd.DataFrame({"query": q_ids[at + i[first]], "id": ids[j[first]], "score": np.where(np.isinf(score[first]), 0.0, score[first]), "place": np.isfinite(score[first]).astype(int)})


def _without_score(q_ids: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    """(query, id) of the k smallest ids of rows that have no score with a query."""
    own = [ids[: k + np.searchsorted(ids, i, "right") - np.searchsorted(ids, i, "left")] for i in q_ids]
    own = [x[x != i][:k] for i, x in zip(q_ids, own, strict=True)]
    return pd.DataFrame({"query": np.repeat(q_ids, [len(x) for x in own]), "id": np.concatenate([*own, ids[:0]]), "score": 0.0, "place": 2})


def nearest(queries: DataFrame, rows: DataFrame, k: int, id: str = "id", vector: str = "vector", digits: int = 6) -> DataFrame:
    """(query, rank, id, score): the k rows of largest cosine of each query, itself apart; ties by id.

    A stated query set against all rows, in blocks of BLOCK components at most:
    queries are copied to the blocks of rows and rows to the blocks of queries,
    each pair of blocks is multiplied and keeps k rows a query, and these are
    merged. Vectors that are null, hold nulls or are of another length than the
    query have no score and come last.
    """
    kind = rows.schema[vector].dataType.elementType.simpleString()
    kind = "float" if kind == queries.schema[vector].dataType.elementType.simpleString() == "float" else "double"
    v = F.col(vector)
    whole = F.when(F.forall(v, lambda x: x.isNotNull()), v.cast(f"array<{kind}>"))
    sides = [df.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), whole.alias("v")) for df in (queries, rows)]
    sizes = [df.agg(F.count("*"), F.max(F.size("v"))).first() for df in sides]
    most = [max(1, -(-n * max(1, width or 1) // BLOCK)) for n, width in sizes]
    most[1] = max(most[1], min(-(-sizes[1][0] // 1024), 4 * rows.sparkSession.sparkContext.defaultParallelism))
    held = [df.withColumn(f"b{n}", F.pmod(F.xxhash64("id"), F.lit(most[n]))).withColumn(f"b{1 - n}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most[1 - n] - 1).cast("long")))).groupBy("b0", "b1") for n, df in enumerate(sides)]

    def solve(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        r = r.sort_values("id", kind="stable")
        width = lambda df: np.array([-1 if x is None else len(x) for x in df["v"]], np.int64)
        q_width, r_width = width(q), width(r)
        out = [pd.DataFrame({"query": q["id"][:0], "id": r["id"][:0], "score": np.zeros(0), "place": np.zeros(0, int)})]
        for w in np.unique(q_width):
            mine, same = q_width == w, (r_width == w) & (w >= 0)
            q_ids, ids = q["id"].to_numpy()[mine], r["id"].to_numpy()
            if same.any():
                out += _best(q_ids, _matrix(q["v"][mine].tolist()), ids[same], _matrix(r["v"][same].tolist()), k, digits)
            if not same.all():
                out.append(_without_score(q_ids, ids[~same], k))
        return pd.concat(out, ignore_index=True)

    kinds = [df.schema["id"].dataType.simpleString() for df in sides]
    local = held[0].cogroup(held[1]).applyInPandas(solve, f"query {kinds[0]}, id {kinds[1]}, score double, place int")  # place: 0 of NaN, 1 of a number, 2 of no score
    rank = F.row_number().over(W.partitionBy("query").orderBy("place", F.desc("score"), "id"))
    ranked = local.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query", "rank", "id", F.when(F.col("place") == 0, float("nan")).when(F.col("place") == 1, F.col("score")).alias("score"))
