"""Exact top-k by integer inner product: a Voronoi kNN join.

Pivots are a bounded, hash-ordered sample of the vectors. Every vector goes to
the cell of its nearest pivot; pivots themselves are gathered in a few groups.
From the cells' summaries (the distances of a few innermost vectors, and the
queries' radius) each query cell i gets a bound: with |q - p_i| <= U_i,

    q.v >= p_i.p_j - |p_i| d - U_i (|p_j| + d)   for a v at distance d of p_j,

so the (k+1)-th best such figure, theta_i, is reached by k vectors besides the
query itself, and a vector v can matter to the cell only if
p_i.v + U_i |v| >= theta_i. Such vectors, and no others, are copied to the
cell's group; groups are cut into blocks of queries and of vectors, solved
locally, and merged by one window per query.

Vectors that are null or hold null or non-finite components, and rows without
an id, take no part. Vectors of unequal lengths are compared as if the shorter
ended in zeros. Of rows that share an id, the least vector counts. Components
may be as large as scores still fit in 64 bits. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.session import written

K = 5
PIVOTS = 128
GROUPS = 8
QUERY_BLOCK = 2048
VECTOR_BLOCK = 8192
SCALE = 256
SEED = 41


def quantised(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component, in order."""
    e = F.col(embedding)
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    whole = F.transform(e, lambda x: F.floor(x.cast("double") * scale))
    usable = rows.where(F.col(vec_id).isNotNull() & e.isNotNull() & F.coalesce(fine, F.lit(False)))
    return usable.select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of v for each q, its own id apart; ties to smaller ids."""
    order = np.argsort(ids, kind="stable")
    ids, v = ids[order], v[order]
    exact = (np.abs(q).sum(1).max(initial=0) * np.abs(v).max(initial=0)) < 2.0**53
    out = []
    for low in range(0, len(q), 64):
        if exact:
            scores = q[low : low + 64] @ v.T
        else:
            scores = q[low : low + 64].astype(np.int64).astype(object) @ v.astype(np.int64).astype(object).T
        for i, row in enumerate(scores):
            who = q_ids[low + i]
            at = np.flatnonzero(ids != who)
            row = row[at]
            if len(row) > k:
                if exact:
                    edge = np.partition(row, len(row) - k)[len(row) - k]
                    near = np.flatnonzero(row >= edge)
                    at, row = at[near], row[near]
                take = np.array(sorted(range(len(row)), key=lambda j: (-row[j], j))[:k], np.int64) if len(row) < 4 * k else np.argsort(-row.astype(float) if exact else -row, kind="stable")[:k]
                at, row = at[take], row[take]
            out.append(pd.DataFrame({"query_id": np.full(len(at), who), "vec_id": ids[at], "score": row.astype(np.int64)}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)


def top_k(vectors: DataFrame, is_query, k: int = K, pivots: int = PIVOTS, groups: int = GROUPS) -> DataFrame:
    """query_id, rank, vec_id, score over vectors (vec_id, v), for the rows that the Column is_query names."""
    context = vectors.sparkSession.sparkContext
    rows = written(vectors.withColumn("query", is_query), "topk-vectors")
    width = rows.agg(F.max(F.size("v"))).first()[0]
    schema = "query_id long, rank int, vec_id long, score long"
    if width is None:
        return vectors.sparkSession.createDataFrame([], schema)
    chosen = rows.orderBy(F.xxhash64(F.lit(SEED), "vec_id"), "vec_id").limit(pivots).select("v").collect()
    p = _matrix([r.v for r in chosen], width)
    square = (p * p).sum(1)
    leaders = p[: min(groups, len(p))]
    group_of = ((leaders * leaders).sum(1)[None, :] - 2 * p @ leaders.T).argmin(1)
    held = context.broadcast((p, square))

    def assign(frames):
        p, square = held.value
        for frame in frames:
            v = _matrix(frame["v"].tolist(), p.shape[1])
            far = np.maximum((v * v).sum(1)[:, None] + square[None, :] - 2 * v @ p.T, 0)
            cell = far.argmin(1)
            yield frame.assign(cell=cell.astype(np.int32), far=np.sqrt(far[np.arange(len(v)), cell]))

    placed = written(rows.mapInPandas(assign, "vec_id long, v array<long>, query boolean, cell int, far double"), "topk-cells")
    inner = placed.select("cell", "far", F.row_number().over(W.partitionBy("cell").orderBy("far", "vec_id")).alias("nth")).where(F.col("nth") <= k + 1).collect()
    radius = dict(placed.where("query").groupBy("cell").agg(F.max("far")).collect())
    if not radius:
        return vectors.sparkSession.createDataFrame([], schema)
    norm, cells = np.sqrt(square), np.array(sorted(radius))
    u = np.array([radius[c] for c in cells])
    j, d = np.array([r.cell for r in inner]), np.array([r.far for r in inner])
    lower = p[cells] @ p[j].T - norm[cells][:, None] * d[None, :] - u[:, None] * (norm[j] + d)[None, :]
    theta = -np.sort(-lower, axis=1)[:, k] if lower.shape[1] > k else np.full(len(cells), -np.inf)
    bounds = context.broadcast((p[cells], u, theta, group_of[cells]))
    n_groups = int(group_of.max()) + 1

    def copy(frames):
        heads, u, theta, of = bounds.value
        for frame in frames:
            v = _matrix(frame["v"].tolist(), heads.shape[1])
            size = np.sqrt((v * v).sum(1))
            reach = v @ heads.T + size[:, None] * u[None, :]
            wanted = reach + 1e-9 * np.abs(reach) + 1e-6 >= theta[None, :]
            for g in range(n_groups):
                near = wanted[:, of == g].any(1)
                if near.any():
                    yield frame.loc[near, ["vec_id", "v"]].assign(g=np.int32(g))

    queries = placed.where("query").join(F.broadcast(vectors.sparkSession.createDataFrame([(i, int(g)) for i, g in enumerate(group_of)], "cell int, g int")), "cell")
    counts = dict(queries.groupBy("g").count().collect())
    copies = placed.select("vec_id", "v").mapInPandas(copy, "vec_id long, v array<long>, g int")
    total = rows.count()
    n_vector_blocks = max(1, -(-total // VECTOR_BLOCK))
    query_blocks = F.element_at(F.create_map(*[F.lit(x) for g in range(n_groups) for x in (g, max(1, -(-counts.get(g, 0) // QUERY_BLOCK)))]), F.col("g"))
    q = queries.select("vec_id", "v", "g", F.pmod(F.xxhash64("vec_id"), query_blocks).alias("qb")).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(n_vector_blocks - 1))))
    v = copies.withColumn("vb", F.pmod(F.xxhash64(F.lit(SEED), "vec_id"), F.lit(n_vector_blocks)).cast("int"))
    v = v.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), query_blocks.cast("long") - 1)))

    def solve(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)
        return _best(q["vec_id"].to_numpy(), _matrix(q["v"].tolist(), width), v["vec_id"].to_numpy(), _matrix(v["v"].tolist(), width), k)

    key = ["g", "qb", "vb"]
    local = q.groupBy(*key).cogroup(v.groupBy(*key)).applyInPandas(solve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
