"""Quality classification by co-training of two views, combined after calibration.

The text view sees hashed words and byte trigrams; the metadata view sees
lang, source and the size of the text, never its content. Both are linear
models. They start from a bounded sample of labelled rows (`labelled`, by a
hash of doc_id; everything beyond it is scored, not learned from). In each
round both views score every document of the corpus on Spark; each view names
the `passed` texts of which it is surest, in both classes by their frequency,
and the other view learns them as its own labels. A part of the labelled
sample, never trained on, calibrates each view and then weighs the two
(logistic regressions on one and on two numbers). Scores of all documents come
from the combination.

A target without both classes in the sample scores its labels' mean (0.5
without labels). Null texts are empty; null metadata is a value of its own;
repeated rows score alike, and equal texts are passed once; a very long text
counts by the shares of its words; documents without doc_id are scored too.
Other columns are ignored.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.session import written

#: Labelled rows that are learned from, at most.
LABELLED = 8000
ROUNDS = 2
#: Texts that each view passes to the other in a round: those of all documents of which it is surest.
PASSED = 400
#: Least calibrated probability of a class at which a view passes a text: a view that knows little passes little.
CONFIDENT = 0.9
#: Places of hashed words, then of byte trigrams, then of the shape of a text.
WORD_BITS, GRAM_BITS, SHAPES = 17, 14, 64
TEXT_SIZE = (1 << WORD_BITS) + (1 << GRAM_BITS) + SHAPES
META_BITS = 10
HELD = 0.25
#: Standard errors of a column's log-odds ratio at which it counts by half; a column below the least is noise.
EVIDENCE, LEAST_EVIDENCE = 4.0, 2.0
#: A document is kept if its quality score is at least this and its toxicity score at most the other.
KEEP_QUALITY, KEEP_TOXIC = 0.5, 0.5


class Rows(NamedTuple):
    """Sparse rows: row i has index[ends[i]:ends[i + 1]] with the values there."""

    index: np.ndarray
    value: np.ndarray
    ends: np.ndarray

    def dot(self, w: np.ndarray) -> np.ndarray:
        """Products with w, in blocks of rows, so that what they take is bounded."""
        out = np.empty(len(self.ends) - 1)
        for low in range(0, len(out), 512):
            ends = self.ends[low : low + 513]
            part = slice(ends[0], ends[-1])
            total = np.concatenate([[0.0], np.cumsum(w[self.index[part]] * self.value[part], dtype=np.float64)])
            out[low : low + 512] = total[ends[1:] - ends[0]] - total[ends[:-1] - ends[0]]
        return out

    def take(self, rows: np.ndarray) -> Rows:
        n = (self.ends[1:] - self.ends[:-1])[rows]
        ends = np.concatenate([[0], np.cumsum(n)])
        index, value = np.empty(ends[-1], self.index.dtype), np.empty(ends[-1], self.value.dtype)
        for low in range(0, len(rows), 512):
            part, m = slice(ends[low], ends[min(low + 512, len(rows))]), n[low : low + 512]
            at = np.arange(part.start, part.stop) - np.repeat(ends[low : low + len(m)] - self.ends[rows[low : low + 512]], m)
            index[part], value[part] = self.index[at], self.value[at]
        return Rows(index, value, ends)


def text_rows(encoded: list[bytes]) -> Rows:
    """Words and byte trigrams, hashed, and three marks of a text's shape.

    A word weighs 0.2 in a text of up to 400 words and 4 / sqrt(words) beyond;
    a trigram weighs 1 / sqrt(trigrams). The shape is the part of distinct
    words, of capitals and of ASCII marks, each in steps of a twentieth.
    """
    from kgspark.llm.words import mixed, word_hashes

    hashes, word_ends = word_hashes(encoded)
    raw = np.frombuffer(b"\n".join([*encoded, b""]), np.uint8)
    data = raw.astype(np.uint64)
    begins = np.concatenate([[0], np.cumsum([len(x) + 1 for x in encoded])])
    grams = data[:-2] << np.uint64(16) | data[1:-1] << np.uint64(8) | data[2:] if len(data) > 2 else data[:0]
    grams = (mixed(grams) & np.uint64((1 << GRAM_BITS) - 1)) + np.uint64(1 << WORD_BITS)
    words = hashes & np.uint64((1 << WORD_BITS) - 1)
    capital = np.concatenate([[0], np.cumsum((raw >= 65) & (raw <= 90))])
    odd = np.concatenate([[0], np.cumsum((raw > 32) & (raw < 128) & ~((raw | 32) >= 97) | (raw > 32) & (raw < 128) & ((raw | 32) > 122))])
    base = np.uint64((1 << WORD_BITS) + (1 << GRAM_BITS))
    parts_i, parts_v, ends = [], [], [0]
    for a, b, c, d in zip(word_ends[:-1].tolist(), word_ends[1:].tolist(), begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        size = max(d - c - 1, 1)
        ratios = [len(np.unique(hashes[a:b])) / max(b - a, 1), (capital[d] - capital[c]) / size, (odd[d] - odd[c]) / size]
        shape = np.array([base + np.uint64(21 * k + min(int(20 * r), 20)) for k, r in enumerate(ratios)], np.uint64)
        d = max(c, d - 3)
        parts_i += [words[a:b], grams[c:d], shape]
        parts_v += [np.full(b - a, max(b - a, 400) ** -0.5 * 4), np.full(d - c, (d - c) ** -0.5 if d > c else 0), np.ones(3)]
        ends.append(ends[-1] + b - a + d - c + 3)
    return Rows(np.concatenate(parts_i).astype(np.int32), np.concatenate(parts_v).astype(np.float32), np.array(ends))


def summed(rows: Rows) -> Rows:
    """The same rows with equal indexes of a row summed: smaller to send and to fit."""
    index, value, ends = [], [], [0]
    for a, b in zip(rows.ends[:-1].tolist(), rows.ends[1:].tolist(), strict=True):
        i, back = np.unique(rows.index[a:b], return_inverse=True)
        index.append(i)
        value.append(np.bincount(back, rows.value[a:b], len(i)).astype(np.float32))
        ends.append(ends[-1] + len(i))
    return Rows(np.concatenate(index), np.concatenate(value), np.array(ends)) if index else Rows(np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(1, np.int64))


def meta_rows(langs: list, sources: list, sizes: list) -> Rows:
    """lang, source, and the power of two of the size, hashed: three ones a row."""
    place = lambda kind, v: zlib.crc32(f"{kind}={v!r}".encode("utf-8", "surrogatepass")) & (1 << META_BITS) - 1
    index = [place(k, v) for row in zip(langs, sources, [int(s).bit_length() if s is not None else None for s in sizes], strict=True) for k, v in zip("lsn", row, strict=True)]
    return Rows(np.array(index, np.int32), np.ones(len(index), np.float32), np.arange(0, len(index) + 1, 3))


def evidence(x: Rows, y: np.ndarray, size: int) -> np.ndarray:
    """What each column counts, from 0 to 1, by how far its log-odds ratio is from zero: rare columns count less, and none is cut at a height."""
    with_one, without = np.full(size, 0.5), np.full(size, 0.5)
    for low in range(0, len(y), 512):  # in blocks of rows, so that what they take is bounded
        ends = x.ends[low : low + 513]
        index, owner = x.index[ends[0] : ends[-1]], np.repeat(y[low : low + 512] > 0.5, np.diff(ends))
        with_one += np.bincount(index[owner], minlength=size)
        without += np.bincount(index[~owner], minlength=size)
    ones, zeros = (y > 0.5).sum() + 1, (y <= 0.5).sum() + 1
    ratio = np.log(with_one / (ones - with_one)) - np.log(without / (zeros - without))
    sure = np.abs(ratio) / np.sqrt(1 / with_one + 1 / (ones - with_one) + 1 / without + 1 / (zeros - without))
    return np.where(sure < LEAST_EVIDENCE, 0.0, sure**2 / (sure**2 + EVIDENCE**2))


def fit(x: Rows, y: np.ndarray, size: int, steps: int = 150, decay: float = 1e-3) -> np.ndarray:
    """Weights and, last, the intercept of a logistic regression on columns scaled by their evidence, by Adam on all rows."""
    scale = evidence(x, y, size)
    used = np.append(scale > 0, True)
    w = np.zeros(size + 1)
    kept = used[x.index]
    ends = np.concatenate([[0], np.cumsum(kept)])[x.ends]
    x = Rows(x.index[kept], x.value[kept] * scale.astype(np.float32)[x.index[kept]], ends)
    first, second = np.zeros_like(w), np.zeros_like(w)
    owner = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(x.ends))
    for step in range(1, steps + 1):
        error = (_sigmoid(x.dot(w) + w[-1]) - y) / len(y)
        grad = np.bincount(x.index, x.value * error[owner], size + 1).astype(float)
        grad[-1] = error.sum()
        grad[:-1] += decay * w[:-1] / max(used.sum(), 1)
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        w -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9) * used
    w[:-1] *= scale
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def calibrate(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients (one per column of z, then the intercept) of a logistic regression by Newton's steps, slightly ridged."""
    x = np.column_stack([z, np.ones(len(z))])
    target = np.where(y > 0.5, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = _sigmoid(x @ w)
        ridge = np.diag([1e-2] * (x.shape[1] - 1) + [1e-6])
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (p - target) + ridge @ w)
    return w


class Model(NamedTuple):
    """A target's two views (weights), their calibrations and their combination; constant if there was nothing to fit."""

    constant: float | None
    text: np.ndarray | None = None
    meta: np.ndarray | None = None
    text_scale: np.ndarray | None = None
    meta_scale: np.ndarray | None = None
    both: np.ndarray | None = None

    def scores(self, text: Rows, meta: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(text.ends) - 1
        if self.constant is not None:
            return (np.full(n, self.constant),) * 3
        a = _line(self.text_scale, text.dot(self.text) + self.text[-1])
        b = _line(self.meta_scale, meta.dot(self.meta) + self.meta[-1])
        return _sigmoid(a), _sigmoid(b), _sigmoid(_line(self.both, np.column_stack([a, b])))


def _line(w: np.ndarray, z: np.ndarray) -> np.ndarray:
    return np.column_stack([z, np.ones(len(z))]) @ w


def joined(parts: list[Rows]) -> Rows:
    ends, total = [np.zeros(1, np.int64)], 0
    for p in parts:
        ends.append(p.ends[1:] + total)
        total += int(p.ends[-1])
    return Rows(np.concatenate([p.index for p in parts]), np.concatenate([p.value for p in parts]), np.concatenate(ends))


class Target(NamedTuple):
    """A target's labels among the sample: y where known, the part that trains and the part that calibrates."""

    y: np.ndarray
    train: np.ndarray
    held: np.ndarray

    @property
    def constant(self) -> float | None:
        if all(len(set((self.y[part] > 0.5).tolist())) == 2 for part in (self.held, self.train)):
            return None
        known = self.held | self.train
        return float(self.y[known].mean()) if known.any() else 0.5


SIZES = (TEXT_SIZE, 1 << META_BITS)


def fitted(views: tuple[Rows, Rows], target: Target, passed: list[list[tuple[Rows, np.ndarray]]]) -> list[np.ndarray]:
    """Each view's weights from the training labels and what was passed to it."""
    out = []
    for v, x in enumerate(views):
        at = np.flatnonzero(target.train)
        rows = joined([x.take(at), *(p[0] for p in passed[v])])
        out.append(fit(rows, np.concatenate([target.y[at], *(p[1] for p in passed[v])]), SIZES[v]))
    return out


def calibrations(views: tuple[Rows, Rows], target: Target, weights: list[np.ndarray]) -> list[np.ndarray]:
    return [calibrate((x.dot(w) + w[-1])[target.held], target.y[target.held]) for x, w in zip(views, weights, strict=True)]


def combined(views: tuple[Rows, Rows], target: Target, weights: list[np.ndarray]) -> Model:
    """The two views, calibrated on the labels held back, and weighed against each other."""
    held, scales = target.held, calibrations(views, target, weights)
    lines = [_line(c, x.dot(w) + w[-1]) for x, w, c in zip(views, weights, scales, strict=True)]
    return Model(None, weights[0], weights[1], *scales, calibrate(np.column_stack(lines)[held], target.y[held]))


def _both_views(batch: pa.RecordBatch):
    """(first row, text rows, metadata rows) of the slices of a batch with text, lang and source."""
    from kgspark.llm.words import slices

    texts = batch.column("text").to_pylist()
    meta = meta_rows(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), [len(t or "") for t in texts])
    for first, encoded in slices(texts):
        yield first, text_rows(encoded), meta.take(np.arange(first, first + len(encoded)))


FEATURES = "text_i array<int>, text_v array<float>, meta_i array<int>"


def _featured(rows: DataFrame, keep: dict[str, str]) -> pa.Table:
    """The columns to keep and both views' features of a bounded number of rows, on the driver."""

    def features(batches):
        for batch in batches:
            for first, text, meta in _both_views(batch):
                n = len(text.ends) - 1
                text, part = summed(text), batch.slice(first, n)
                ends = pa.array(text.ends.astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(text.index)), pa.ListArray.from_arrays(ends, pa.array(text.value)), pa.ListArray.from_arrays(pa.array(meta.ends.astype(np.int32)), pa.array(meta.index))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *lists], names=[*keep, "text_i", "text_v", "meta_i"])

    return rows.select(*keep, "text", "lang", "source").mapInArrow(features, ", ".join(f"{k} {v}" for k, v in keep.items()) + ", " + FEATURES).toArrow()


def _views(table: pa.Table) -> tuple[Rows, Rows]:
    table = table.combine_chunks()
    flat = lambda c: table.column(c).combine_chunks()
    ends = lambda c: np.concatenate([[0], np.cumsum(flat(c).value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    meta_index = flat("meta_i").flatten().to_numpy()
    return Rows(flat("text_i").flatten().to_numpy(), flat("text_v").flatten().to_numpy(), ends("text_i")), Rows(meta_index, np.ones(len(meta_index), np.float32), ends("meta_i"))


def surest(docs: DataFrame, weights: dict[int, list[tuple[np.ndarray, np.ndarray]]], counts: dict[int, tuple[int, int]], sampled: np.ndarray) -> DataFrame:
    """(target, view, high, hash): the texts of which each view is surest, over all documents but the sampled texts.

    counts: how many of the low and of the high class each view of a target
    names. A task keeps as many candidates for each, and these are ranked
    together; equal texts are one. Only texts whose class has a calibrated
    probability of CONFIDENT are named; weights come with their calibrations.
    """
    least = float(np.log(CONFIDENT / (1 - CONFIDENT)))
    held = docs.sparkSession.sparkContext.broadcast((weights, counts, sampled))

    def look(batches):
        weights, counts, sampled = held.value
        best: dict[tuple, dict[int, float]] = {}
        for batch in batches:
            keys = batch.column("hash").to_numpy()
            for first, *views in _both_views(batch):
                mine = keys[first : first + len(views[0].ends) - 1]
                open_ = ~np.isin(mine, sampled)
                for t, ws in weights.items():
                    for v, (w, scale) in enumerate(ws):
                        z = _line(scale, views[v].dot(w) + w[-1])
                        for high in (0, 1):
                            side = z if high else -z
                            n, at = counts[t][high], np.flatnonzero(open_ & (side >= least))
                            if len(at) > n:
                                at = at[np.argsort(-side[at], kind="stable")[: 4 * n]]
                            found = best.setdefault((t, v, high), {})
                            found.update(zip(mine[at].tolist(), side[at].tolist(), strict=True))
                            if len(found) > 8 * n:
                                best[t, v, high] = dict(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:n])
        rows = [(*k, h, s) for k, found in best.items() for h, s in sorted(found.items(), key=lambda x: (-x[1], x[0]))[: counts[k[0]][k[2]]]]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["target", "view", "high", "hash", "side"])

    rows = docs.select(F.xxhash64("text").alias("hash"), "text", "lang", "source").mapInArrow(look, "target int, view int, high int, hash long, side double")
    once = rows.groupBy("target", "view", "high", "hash").agg(F.max("side").alias("side"))
    turn = F.row_number().over(W.partitionBy("target", "view", "high").orderBy(F.desc("side"), "hash"))
    n = F.element_at(F.create_map(*[F.lit(x) for t, c in counts.items() for high in (0, 1) for x in (2 * t + high, c[high])]), 2 * F.col("target") + F.col("high"))
    return once.withColumn("turn", turn).where(F.col("turn") <= max(max(c) for c in counts.values())).where(F.col("turn") <= n).select("target", "view", "high", "hash")


def train(docs: DataFrame, labels: DataFrame, targets: tuple = ("quality", "toxic"), labelled: int = LABELLED, rounds: int = ROUNDS, passed: int = PASSED) -> list[Model]:
    """One Model per target, from at most `labelled` labelled documents and what the views pass each other from all the others."""
    order = F.xxhash64(F.lit(7), "doc_id")
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.min(t).cast("double").alias(t) for t in targets]).where(F.coalesce(*targets).isNotNull())
    # Copies would make whatever their text holds look telling: of equal labelled texts the first by the order counts.
    ids = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("hash")).join(known, "doc_id").withColumn("_order", order)
    ids = ids.groupBy("hash").agg(F.min(F.struct("_order", "doc_id", *targets)).alias("s")).select("hash", "s.*")
    chosen = ids.orderBy("_order", "doc_id").limit(labelled).withColumnsRenamed({"doc_id": "_id", "hash": "_hash"})
    keyed = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text", "lang", "source")
    sample = keyed.join(F.broadcast(chosen), (F.col("doc_id") == F.col("_id")) & (F.col("hash") == F.col("_hash")))  # `labelled` rows at most
    sample = sample.groupBy("_hash").agg(F.min(F.struct("doc_id", "_order", *targets, "text", "lang", "source")).alias("s")).select(F.col("_hash").alias("hash"), "s.*")
    table = _featured(sample.withColumn("doc_id", F.col("doc_id").cast("long")), {"doc_id": "long", "hash": "long", "_order": "long"} | {t: "double" for t in targets})
    table = table.sort_by([("_order", "ascending"), ("doc_id", "ascending")])
    if not len(table):
        return [Model(0.5) for _ in targets]
    views = _views(table)
    chance = (table.column("_order").to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)) / float(1 << 53)
    goals = []
    for t in targets:
        y = table.column(t).to_numpy().astype(float)
        there = ~np.isnan(y)
        goals.append(Target(np.nan_to_num(y), there & (chance >= HELD), there & (chance < HELD)))
    open_ = [k for k, g in enumerate(goals) if g.constant is None]
    handed = {k: [[], []] for k in open_}
    sampled = table.column("hash").to_numpy().copy()
    del table
    for turn in range(rounds + 1):
        weights = {k: fitted(views, goals[k], handed[k]) for k in open_}
        if turn == rounds or not open_:
            break
        highs = {k: max(1, int(passed * goals[k].y[goals[k].train].mean())) for k in open_}
        sure = {k: list(zip(w, calibrations(views, goals[k], w), strict=True)) for k, w in weights.items()}
        found = written(surest(docs, sure, {k: (max(1, passed - h), h) for k, h in highs.items()}, sampled), "quality-surest")
        named = found.toArrow()  # at most `passed` rows a target and view
        wanted = found.select(F.col("hash").alias("_hash")).distinct()
        texts = keyed.join(F.broadcast(wanted), F.col("hash") == F.col("_hash")).groupBy("hash").agg(F.min(F.struct("text", "lang", "source")).alias("s")).select("hash", "s.*")
        got = _featured(texts, {"hash": "long"})
        if not len(got):
            continue
        row_of, features = {h: i for i, h in enumerate(got.column("hash").to_pylist())}, _views(got)
        for k in open_:
            for v in (0, 1):  # what view v names, the other one learns
                mine = [(row_of[h], float(high)) for t, view, high, h in zip(*(named.column(c).to_pylist() for c in ("target", "view", "high", "hash")), strict=True) if t == k and view == v and h in row_of]
                if mine:
                    at, label = np.array([m[0] for m in mine]), np.array([m[1] for m in mine])
                    handed[k][1 - v].append((features[1 - v].take(at), label))
    return [Model(g.constant) if g.constant is not None else combined(views, g, weights[k]) for k, g in enumerate(goals)]


def score(docs: DataFrame, models: list[Model], targets: tuple = ("quality", "toxic")) -> DataFrame:
    """doc_id and, per target t: t_score, t_text_score, t_meta_score, for every document."""
    held = docs.sparkSession.sparkContext.broadcast(models)
    names = [f"{t}_{s}" for t in targets for s in ("score", "text_score", "meta_score")]

    def predict(batches):
        for batch in batches:
            for first, text, meta in _both_views(batch):
                columns = []
                for model in held.value:
                    a, b, both = model.scores(text, meta)
                    columns += [pa.array(np.round(c, 6)) for c in (both, a, b)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(text.ends) - 1), *columns], names=["doc_id", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")
    return rows.mapInArrow(predict, "doc_id long, " + ", ".join(f"{n} double" for n in names))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, quality_score, toxic_score, each view's scores, and keep: of good quality and not toxic."""
    scored = score(docs, train(docs, labels))
    return scored.withColumn("keep", (F.col("quality_score") >= KEEP_QUALITY) & (F.col("toxic_score") <= KEEP_TOXIC))
