"""Document fingerprints by Order MinHash, sensitive to edit distance.

A text's items are its k-mers of code points, numbered by occurrence: the
second "abcabc.." is another item than the first. Each of `functions`
permutations of the items' 32-bit hashes (multiplication by an odd number of
its own, modulo 2^32) picks the `least` smallest items, puts them in the order in which
they stand in the text, and hashes that tuple. Two texts agree at a place if
they share its items and their order, so the share of equal places falls with
edits, and with moved passages too.

Items are numbered from a text's start, so an edit of its end leaves those
before as they are: what the permutations pick there is found once, and serves
the text and its edited form.

A text shorter than k is one item; with fewer than `least` items a tuple holds
them all; an empty (or null) text has a fixed fingerprint. Equal texts have
equal fingerprints, repeated rows too. A very long text is worked through in
blocks of BLOCK items.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.llm.words import mixed
from kgspark.session import written

K = 8
FUNCTIONS = 64
LEAST = 2
#: Items that meet all permutations at once.
BLOCK = 4096
_FACTORS = np.random.default_rng(11).integers(1 << 28, 1 << 31, FUNCTIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_INVERSES = np.array([pow(int(f), -1, 1 << 32) for f in _FACTORS], np.uint32)
_B = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint32(0xFFFFFFFF)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def items(c: np.ndarray, k: int = K) -> np.ndarray:
    """32-bit hashes of the numbered k-mers of code points, in text order."""
    h, width = (c.astype(np.uint64) + np.uint64(1)) * _B, 1
    h ^= h >> np.uint64(29)
    full, done = min(k, len(c)), []
    rest = full
    while rest:  # blocks of 1, 2, 4, ... joined as the bits of the width ask
        if rest & 1:
            done.append((width, h))
        rest >>= 1
        if rest:
            h = h[:-width] * np.uint64(pow(int(_B), width, 1 << 64)) + h[width:]
            width *= 2
    n, at, out = len(c) - full + 1, 0, np.zeros(len(c) - full + 1, np.uint64)
    for width, part in done:
        out = out * np.uint64(pow(int(_B), width, 1 << 64)) + part[at : at + n]
        at += width
    out = mixed(out)
    ordered = np.sort(out)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(twice):  # number the occurrences, in text order
        at = np.searchsorted(twice, out)
        places = np.flatnonzero(twice[np.minimum(at, len(twice) - 1)] == out)
        places = places[np.argsort(out[places], kind="stable")]
        heads = out[places]
        first = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]]))
        number = np.arange(len(places)) - np.repeat(first, np.diff(np.append(first, len(places))))
        out[places] = np.where(number > 0, mixed(heads + mixed(number.astype(np.uint64))), heads)
    return (out >> np.uint64(32)).astype(np.uint32)


class Picks(NamedTuple):
    """Per permutation: the `least` smallest items, permuted, and their places; the smallest first."""

    value: np.ndarray
    place: np.ndarray


def picked(hashes: np.ndarray, start: int, least: int = LEAST) -> Picks:
    """What each permutation picks of hashes, the first of which stands at place start."""
    value, place = np.full((FUNCTIONS, least), _NONE), np.full((FUNCTIONS, least), -1, np.int64)
    rows = np.arange(FUNCTIONS)
    for low in range(0, len(hashes), BLOCK):
        permuted = hashes[None, low : low + BLOCK] * _FACTORS[:, None]
        found = []
        for _ in range(min(least, permuted.shape[1])):
            at = permuted.argmin(1)
            found.append((permuted[rows, at].copy(), at + start + low))
            permuted[rows, at] = _NONE
        value, place = _least(value, place, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1), least)
    return Picks(value, place)


def _least(value, place, more, at, least: int) -> tuple[np.ndarray, np.ndarray]:
    value, place = np.concatenate([value, more], 1), np.concatenate([place, at], 1)
    # Of equal values the earlier place comes first; empty ones stand last.
    order = np.argsort(value, axis=1, kind="stable")[:, :least]
    return np.take_along_axis(value, order, 1), np.take_along_axis(place, order, 1)


def together(a: Picks, b: Picks) -> Picks:
    return Picks(*_least(a.value, a.place, b.value, b.place, a.value.shape[1]))


def sealed(picks: Picks) -> np.ndarray:
    """FUNCTIONS 32-bit numbers: the picks in text order, hashed."""
    order = np.argsort(picks.place, axis=1)  # no pick: place -1
    value = np.take_along_axis(np.where(picks.place < 0, np.uint32(0), picks.value * _INVERSES[:, None]), order, 1)
    out = np.zeros(FUNCTIONS, np.uint64)
    for column in value.astype(np.uint64).T:
        out = mixed(out * _B + column + np.uint64(1))
    return (out >> np.uint64(32)).astype(np.uint32)


_EMPTY = np.zeros(FUNCTIONS, np.uint32)


def fingerprint(text: str) -> np.ndarray:
    """FUNCTIONS 32-bit numbers."""
    c = points(text)
    return sealed(picked(items(c), 0)) if len(c) else _EMPTY


def with_edited(text: str, following: str) -> tuple[str, np.ndarray, np.ndarray]:
    """(edited text, fingerprint of the text, fingerprint of the edited text): the common start is worked through once."""
    changed = edited(text, following)
    if len(text) < 4 * K:
        return changed, fingerprint(text), fingerprint(changed)
    shared = len(text) - len(text) // 4 - K + 1  # items that end before the edit
    mine, its = items(points(text)), items(points(changed))
    start = picked(mine[:shared], 0)
    return changed, sealed(together(start, picked(mine[shared:], shared))), sealed(together(start, picked(its[shared:], shared)))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def edited(text: str, following: str) -> str:
    """text with its last quarter of code points replaced by the first as many of the following text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


class _Out:
    """Rows to be sent as one batch."""

    names = ["pid", "kind", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "text"]
    types = [pa.int32(), pa.int8(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.string()]
    schema = "pid int, kind byte, doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, text string"

    def __init__(self):
        self.rows = []

    def end(self, pid: int, kind: int, doc_id, text: str) -> None:
        self.rows.append((pid, kind, doc_id, len(text), None, None, None, None, None, text))

    def result(self, pid: int, doc_id, text: str, following: str, mine: np.ndarray, its: np.ndarray, changed: str, next_one: np.ndarray) -> None:
        digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        self.rows.append((pid, 0, doc_id, len(text), digest, mine.tobytes(), its.tobytes(), likeness(mine, its), likeness(mine, next_one), None))

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[]] * len(self.names)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self.types, strict=True)], names=self.names)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hexadecimal), near_edited, near_next of every document.

    The next document is that of the next doc_id (ties: by text; null doc_ids
    first; after the last, the first; of a single one, itself). Rows are
    range-partitioned and sorted once; within a partition the next row is at
    hand. A partition's last row and the next partition's first one are set
    aside with their texts and meet in a join of two rows a partition.
    """

    def walk(batches):
        # A row's result waits for the fingerprint of the next row, which is made with that row's own successor.
        out, held, waiting = _Out(), None, None
        for batch in batches:
            for pid, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("pid", "doc_id", "text")), strict=True):
                if held is None:
                    out.end(pid, 1, doc_id, text)
                else:
                    changed, mine, its = with_edited(held[1], text)
                    if waiting is not None:
                        out.result(pid, *waiting, mine)
                    waiting = (*held, text, mine, its, changed)
                held = doc_id, text
                if len(out.rows) >= 1000:
                    yield out.batch()
        if held is not None:
            if waiting is not None:
                out.result(pid, *waiting, fingerprint(held[1]))
            out.end(pid, 2, *held)
        yield out.batch()

    def close(batches):
        out = _Out()
        for batch in batches:
            for pid, doc_id, text, following in zip(*(batch.column(c).to_pylist() for c in ("pid", "doc_id", "text", "following")), strict=True):
                changed, mine, its = with_edited(text, following)
                out.result(pid, doc_id, text, following, mine, its, changed, fingerprint(following))
            yield out.batch()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    walked = written(rows.withColumn("pid", F.spark_partition_id()).mapInArrow(walk, _Out.schema), "fingerprints")
    heads, tails = walked.where("kind = 1"), walked.where("kind = 2")
    order = W.orderBy("pid")
    turn = heads.select("pid", F.coalesce(F.lead("pid").over(order), F.min("pid").over(W.partitionBy())).alias("next_pid"))
    heads = heads.select(F.col("pid").alias("next_pid"), F.col("text").alias("following"))
    last = tails.join(turn, "pid").join(heads, "next_pid").select("pid", "doc_id", "text", "following")
    found = walked.where("kind = 0").unionByName(last.mapInArrow(close, _Out.schema))
    hexed = lambda c: F.lower(F.hex(c)).alias(c)
    return found.select("doc_id", "n_chars", "edited_sha256", hexed("fingerprint"), hexed("edited_fingerprint"), "near_edited", "near_next")
