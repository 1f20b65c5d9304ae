"""Product codes of vectors by Lloyd's rounds with filtering.

A vector of integers is cut into equal parts; each part position has a codebook
of its own. Every partition builds, once, kd-trees over its parts: one a chunk
of CHUNK vectors and part position, with each node's bounding box and cached sum and
count. In a round the codebooks go to the trees, and a tree is walked level by
level with the entries that may still be nearest to a node's points: an entry goes
if another one is nearer throughout the box (its corner farthest towards the entry
tells: the difference of two squared distances is linear). A node with one entry left
is assigned as a whole, by its cached sum and count; leaves' points are compared
with what is left. Only the entries' sums and counts leave a task: their number
is parts x entries, whatever the corpus.

Vectors that are null or hold null or non-finite components are dropped. Shorter
ones end in zeros, up to the longest one's length and to a multiple of the parts.
Scaled components beyond +-2^25 count as that, so that squared distances fit in
64 bits. Entries start from the vectors of the smallest ids (null ids last, equal
ids in the vectors' order); with fewer vectors than that, there are fewer entries.
Repeated rows count each time. Other columns stay out. An empty table has empty codebooks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.session import written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
MOST = 1 << 25
#: Vectors of a chunk, and points of a leaf.
CHUNK, LEAF = 4096, 16
#: Components that a chunk holds at most, so that wide vectors have smaller chunks.
CHUNK_COMPONENTS = 1 << 19
_FLOOR = 256


def quantised(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """vec_id, label, v: floor(scale * x) of each component, without the rows that have none to keep."""
    e = F.col(embedding)
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    whole = F.transform(e, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int"))
    return rows.where(e.isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), whole.alias("v"))


class Tree:
    """A complete kd-tree over points, in the order of which leaves and nodes are ranges.

    Level l has 2^l nodes; node i holds the points from i * n / 2^l on. order:
    the points' places before; boxes, sums: a row per node, level by level.
    """

    def __init__(self, points: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray):
        self.points, self.order, self.low, self.high, self.sums = points, order, low, high, sums
        self.depth = len(low).bit_length() - 1

    @staticmethod
    def bounds(n: int, level: int) -> np.ndarray:
        """Where each node of a level starts, and the end of the last."""
        return (n * np.arange((1 << level) + 1)) >> level

    @classmethod
    def build(cls, points: np.ndarray) -> Tree:
        n, order = len(points), np.arange(len(points))
        depth = max(0, -(-n // LEAF) - 1).bit_length()
        for level in range(depth):
            starts, own = cls.bounds(n, level), points[order]
            spread = np.maximum.reduceat(own, starts[:-1]) - np.minimum.reduceat(own, starts[:-1])
            node = np.repeat(np.arange(1 << level), np.diff(starts))
            order = order[np.lexsort((own[np.arange(n), spread.argmax(1)[node]], node))]
        own, starts = points[order], cls.bounds(n, depth)[:-1]
        low, high, sums = [np.minimum.reduceat(own, starts)], [np.maximum.reduceat(own, starts)], [np.add.reduceat(own, starts)]
        for _ in range(depth):
            low.insert(0, np.minimum(low[0][::2], low[0][1::2]))
            high.insert(0, np.maximum(high[0][::2], high[0][1::2]))
            sums.insert(0, sums[0][::2] + sums[0][1::2])
        return cls(own, order, *map(np.concatenate, (low, high, sums)))

    def assign(self, entries: np.ndarray, owned: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Sums and counts of the points of each entry, ties to the lower index; with owned, each point's entry in the tree's order."""
        k, n = len(entries), len(self.points)
        sums, counts, who = np.zeros_like(entries), np.zeros(k, np.int64), np.empty(n, np.int64) if owned else None

        def give(entry: np.ndarray, total: np.ndarray, count: np.ndarray) -> None:
            np.add.at(sums, entry, total)
            np.add.at(counts, entry, count)

        node, open_ = np.zeros(1, np.int64), np.ones((1, k), bool)
        for level in range(self.depth + 1):
            at, starts = node + (1 << level) - 1, self.bounds(n, level)
            open_ = filtered(entries, self.low[at], self.high[at], open_)
            whole = open_.sum(1) == 1
            if whole.any():
                entry, done = open_[whole].argmax(1), node[whole]
                give(entry, self.sums[at[whole]], starts[done + 1] - starts[done])
                if owned:
                    for e, a, b in zip(entry, starts[done], starts[done + 1], strict=True):
                        who[a:b] = e
            node, open_ = node[~whole], open_[~whole]
            if level < self.depth:
                node, open_ = np.stack([2 * node, 2 * node + 1], 1).ravel(), np.repeat(open_, 2, 0)
        sizes = starts[node + 1] - starts[node]
        at = np.repeat(starts[node] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        own = self.points[at]
        far = ((own[:, None, :] - entries[None, :, :]) ** 2).sum(2)
        far[~np.repeat(open_, sizes, 0)] = np.iinfo(np.int64).max
        entry = far.argmin(1)
        give(entry, own, np.ones(len(at), np.int64))
        if owned:
            who[at] = entry
        return sums, counts, who


def filtered(entries: np.ndarray, low: np.ndarray, high: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """open_ (box, entry) without the entries to which another open one is nearer all over the box, or as near and of lower index."""
    k = len(entries)
    middle = (low + high)[:, None, :] / 2
    far = np.where(open_, ((entries[None].astype(float) - middle) ** 2).sum(2), np.inf)
    best = far.argmin(1)
    u = entries[None] - entries[best][:, None]
    corner = np.where(u > 0, high[:, None, :], low[:, None, :])
    least = (u * (entries[None] + entries[best][:, None] - 2 * corner)).sum(2)
    beaten = (least > 0) | ((least == 0) & (np.arange(k)[None] > best[:, None]))
    return open_ & ~beaten


def _packed(tree: Tree) -> list[bytes]:
    return [np.ascontiguousarray(a, kind).tobytes() for a, kind in ((tree.points, "<i4"), (tree.order, "<i4"), (tree.low, "<i4"), (tree.high, "<i4"), (tree.sums, "<i8"))]


def _unpacked(parts: list[bytes], width: int) -> Tree:
    points, order, low, high, sums = (np.frombuffer(b, kind).astype(np.int64) for b, kind in zip(parts, ("<i4", "<i4", "<i4", "<i4", "<i8"), strict=True))
    return Tree(points.reshape(-1, width), order, low.reshape(-1, width), high.reshape(-1, width), sums.reshape(-1, width))


_TREE = "points binary, order binary, low binary, high binary, sums binary"


def forest(vectors: DataFrame, width: int, parts: int = PARTS) -> DataFrame:
    """One row a chunk of vectors(vec_id, label, v): ids, labels and a tree per part. width: components of a part. Written once, read each round."""
    kind = vectors.schema["label"].dataType.simpleString()
    most = max(_FLOOR, min(CHUNK, CHUNK_COMPONENTS // max(1, width * parts)))

    def build(batches):
        held, rows = [], 0

        def chunk():
            table = pa.Table.from_batches(held).combine_chunks()
            v = np.zeros((table.num_rows, width * parts), np.int64)
            for row, own in zip(v, table.column("v").to_pylist(), strict=True):
                row[: len(own)] = own
            trees = [dict(zip(("points", "order", "low", "high", "sums"), _packed(Tree.build(v[:, p * width : (p + 1) * width])), strict=True)) for p in range(parts)]
            lists = [pa.array([table.column(c).to_pylist()], pa.list_(table.schema.field(c).type)) for c in ("vec_id", "label")]
            return pa.RecordBatch.from_arrays([*lists, pa.array([trees], pa.list_(pa.struct([(c, pa.binary()) for c in ("points", "order", "low", "high", "sums")])))], names=["ids", "labels", "trees"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, most - rows)
                held.append(some)
                at, rows = at + some.num_rows, rows + some.num_rows
                if rows == most:
                    yield chunk()
                    held, rows = [], 0
        if rows:
            yield chunk()

    return written(vectors.select("vec_id", "label", "v").mapInArrow(build, f"ids array<long>, labels array<{kind}>, trees array<struct<{_TREE}>>"), "codes-trees")


def _trees(row_trees, width: int) -> list[Tree]:
    return [_unpacked([t[c] for c in ("points", "order", "low", "high", "sums")], width) for t in row_trees]


def moved(trees: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks (part, entry, component) after a round: floors of their parts' means; unused entries stay."""
    parts, entries, width = codebooks.shape

    def walk(batches):
        sums, counts = np.zeros_like(codebooks), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for row in batch.column("trees"):
                for p, tree in enumerate(_trees(row.as_py(), width)):
                    s, c, _ = tree.assign(codebooks[p])
                    sums[p] += s
                    counts[p] += c
        part, entry = map(np.ravel, np.indices((parts, entries)))
        flat = pa.ListArray.from_arrays(np.arange(parts * entries + 1, dtype=np.int32) * width, pa.array(sums.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts.ravel()), flat], names=["part", "entry", "n", "sums"])

    rows = trees.select("trees").mapInArrow(walk, "part int, entry int, n long, sums array<long>").where("n > 0")
    places = rows.select("part", "entry", "n", F.posexplode("sums").alias("place", "s"))
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    out = codebooks.copy()
    for r in places.groupBy("part", "entry", "place").agg(wide("s").alias("s"), wide("n").alias("n")).collect():  # parts x entries x components
        out[r.part, r.entry, r.place] = int(r.s) // int(r.n)
    return out


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """The forest over vectors(vec_id, label, v), and the codebooks (part, entry, component) after the rounds."""
    vectors = written(vectors, "codes-vectors")
    longest = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // parts)
    first = [r.v for r in vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    start = np.zeros((len(first), width * parts), np.int64)
    for row, v in zip(start, first, strict=True):
        row[: len(v)] = v
    codebooks = np.ascontiguousarray(start.reshape(len(first), parts, width).transpose(1, 0, 2))
    trees = forest(vectors, width, parts)
    for _ in range(rounds if first and width else 0):
        codebooks = moved(trees, codebooks)
    return trees, codebooks


def coded(trees: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """vec_id, label, code (an entry a part, two hex digits each), error (squared distances summed over parts) of the forest's vectors."""
    parts, entries, width = codebooks.shape
    kind = trees.schema["labels"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ids, labels = batch.column("ids")[k].values, batch.column("labels")[k].values
                codes, error = np.zeros((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
                for p, tree in enumerate(_trees(batch.column("trees")[k].as_py(), width) if width else []):
                    _, _, who = tree.assign(codebooks[p], owned=True)
                    codes[tree.order, p] = who
                    error[tree.order] += ((tree.points - codebooks[p][who]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return trees.mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def decoded(codes: DataFrame, codebooks: np.ndarray, code: str = "code", scale: int = SCALE) -> DataFrame:
    """codes with approx array<double>: the entries that the code names, scaled back."""
    books = codebooks / scale

    @F.pandas_udf("array<double>")
    def approx(codes: pd.Series) -> pd.Series:
        return codes.map(lambda c: np.concatenate([books[p, e] for p, e in enumerate(bytes.fromhex(c))]))

    return codes.withColumn("approx", approx(code))


def named(codebooks: np.ndarray) -> str:
    """The sha256 of all components as decimals, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def digest(rows: DataFrame, **how) -> DataFrame:
    """vec_id, code, error, label_error (the errors of all rows of equal label), codebooks_sha256."""
    trees, codebooks = fit(quantised(rows), **how)
    codes = written(coded(trees, codebooks), "codes")
    totals = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    met = codes.join(totals, F.col("label").eqNullSafe(F.col("_label")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(named(codebooks)).alias("codebooks_sha256"))


def _rounds() -> str:
    """Assignments and means of the rounds, one after the other."""
    out = []
    for r in range(ROUNDS + 1):
        out.append(f"""a{r} AS MATERIALIZED (SELECT id, part, arg_min(entry, (far, entry)) AS entry, min(far) AS far, any_value(p) AS p
            FROM (SELECT x.id, x.part, x.p, b.entry, list_sum(list_transform(list_zip(x.p, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS far FROM x JOIN b{r} b USING (part)) GROUP BY id, part)""")
        if r < ROUNDS:
            out.append(f"""b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.e, b.e) AS e FROM b{r} b LEFT JOIN (SELECT part, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY place) AS e
            FROM (SELECT part, entry, place, sum(c)::BIGINT AS s, count(*) AS n FROM (SELECT part, entry, unnest(p) AS c, generate_subscripts(p, 1) AS place FROM a{r}) GROUP BY part, entry, place) GROUP BY part, entry) m USING (part, entry))""")
    return ",\n    ".join(out)


ORACLE = f"""
    WITH v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS id, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    x AS MATERIALIZED (SELECT id, part, v[part * (len(v) // {PARTS}) + 1:(part + 1) * (len(v) // {PARTS})] AS p FROM v, range({PARTS}) r(part)),
    b0 AS (SELECT part, id - 1 AS entry, p AS e FROM x WHERE id <= {ENTRIES}),
    {_rounds()},
    c AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM a{ROUNDS} GROUP BY id),
    h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN c USING (id), h"""
