"""Language identification by language-bitmask n-gram filters.

An n-gram is four bytes of the lower-cased UTF-8 text, in which every ASCII
character but a letter counts as a space and runs of spaces as one. It
belongs to a language if it makes up at least `share` of the n-grams of that
language's learning documents, counted over all of them: so a language has at
most 1 / share n-grams, whatever the size of the corpus.

The filter is a Bloom filter cut into bit slices: each of its places holds a
bit for every language, and the AND of the words at an n-gram's places names
all languages that contain it at once. A text's n-grams are counted per
language, false positives are taken off by each language's own rate, and the
language with the largest corrected share is predicted (ties: the first by
code point). The score is that share, times the winner's part of the sum of
the two best.

A null text, or one without a letter, is `und` with score 0; so is every text
if nothing could be learned. Null doc_ids neither teach nor are held out.
Repeated rows are predicted alike. Other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.extras import extras_aside

SHARE = 1e-5
PLACES = 1 << 20
HASHES = 3
#: A prediction with a smaller score is no language, for keep().
LEAST_SCORE = 0.15
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = [b if 97 <= b <= 122 else 32 for b in range(128)]
_ODD = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class Filters(NamedTuple):
    """languages, sorted; words (PLACES, ceil(languages / 64)); rates: of false positives, by language."""

    languages: list[str]
    words: np.ndarray
    rates: np.ndarray


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _grams(encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams as 32-bit numbers, ends): of all texts together; text i has grams[ends[i]:ends[i + 1]]. No n-gram crosses texts."""
    raw = _FOLD[np.frombuffer(b"\n".join([*encoded, b""]), np.uint8)]
    keep = np.concatenate([raw[1:] != 32, [True]]) | (raw != 32)
    begins = np.concatenate([[0], np.cumsum([len(x) + 1 for x in encoded])])
    begins = np.concatenate([[0], np.cumsum(keep)])[begins]
    raw = raw[keep].astype(np.uint32)
    if len(raw) < 4:
        return np.zeros(0, np.uint32), np.zeros(len(encoded) + 1, np.int64)
    grams = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
    # Texts end in a space; a gram with a space before its last byte spans words (or texts) and doesn't count.
    inner = (raw[1:-2] != 32) & (raw[2:-1] != 32)
    return grams[inner], np.concatenate([[0], np.cumsum(inner)])[np.minimum(begins, len(inner))]


def _places(grams: np.ndarray) -> list[np.ndarray]:
    shift = np.uint64(64 - (PLACES - 1).bit_length())
    wide = (grams.astype(np.uint64) + np.uint64(1)) * _ODD[3]
    wide ^= wide >> np.uint64(32)
    return [((wide * odd) >> shift).astype(np.int64) for odd in _ODD[:HASHES]]


def learn(docs: DataFrame, share: float = SHARE) -> Filters:
    """Filters from all learning documents: those with text and lang that aren't held out."""

    def count(batches):
        from kgspark.llm.words import slices

        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            found: dict[str, list] = {}
            for first, encoded in slices([t.lower() for t in batch.column("text").to_pylist()]):
                grams, ends = _grams(encoded)
                mine = np.repeat(langs[first : first + len(encoded)], np.diff(ends))
                for lang in set(langs[first : first + len(encoded)]):
                    found.setdefault(lang, []).append(grams[mine == lang])
            for lang, parts in found.items():
                gram, times = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(times)], names=["lang", "gram", "times"])

    taught = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = taught.select("lang", "text").mapInArrow(count, "lang string, gram long, times long").groupBy("lang", "gram").agg(F.sum("times").alias("times"))
    counts = counts.groupBy("lang").agg(F.sum("times").alias("all")).withColumnRenamed("lang", "l").join(counts, F.col("l") == F.col("lang"))
    member = counts.where(F.col("times") >= share * F.col("all")).select("lang", "gram").toArrow()  # at most languages / share rows
    langs = np.array(member.column("lang").to_pylist(), object)
    languages = sorted(set(langs))
    words, rates = np.zeros((PLACES, max(1, -(-len(languages) // 64))), np.uint64), []
    for k, lang in enumerate(languages):
        bit, slot = np.uint64(1 << (k % 64)), k // 64
        for at in _places(member.column("gram").to_numpy()[langs == lang]):
            words[at, slot] |= bit
        rates.append(np.mean((words[:, slot] & bit) > 0) ** HASHES)
    return Filters(languages, words, np.array(rates))


def shares(filters: Filters, encoded: list[bytes]) -> np.ndarray:
    """(texts, languages): the part of each text's n-grams that the language contains, false positives taken off."""
    grams, ends = _grams(encoded)
    n = np.diff(ends)
    places, out = _places(grams), np.zeros((len(encoded), len(filters.languages)))
    for slot in range(filters.words.shape[1]):
        named = filters.words[:, slot][places[0]]
        for at in places[1:]:
            named &= filters.words[:, slot][at]
        for k in range(64 * slot, min(64 * slot + 64, len(filters.languages))):
            held = (named >> np.uint64(k % 64)).astype(np.uint8) & 1
            total = np.concatenate([[0], np.cumsum(held, dtype=np.int64)])
            hits = total[ends[1:]] - total[ends[:-1]]
            rate = filters.rates[k]
            out[:, k] = np.clip((hits / np.maximum(n, 1) - rate) / max(1 - rate, 1e-9), 0, 1)
    return out


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """docs' columns doc_id and text -> doc_id, lang_pred, score."""
    held = docs.sparkSession.sparkContext.broadcast(filters)

    def predict(batches):
        from kgspark.llm.words import slices

        filters = held.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            if filters.languages:
                for first, encoded in slices([(t or "").lower() for t in texts]):
                    found = shares(filters, encoded)
                    best = found.argmax(1)
                    top = found[np.arange(len(best)), best]
                    found[np.arange(len(best)), best] = 0
                    scores[first : first + len(best)] = top * top / np.maximum(top + found.max(1), 1e-12)
                    langs[first : first + len(best)] = [filters.languages[k] for k in best]
            lettered = batch.column("lettered").to_pylist()
            langs = [lang if ok else "und" for lang, ok in zip(langs, lettered, strict=True)]
            scores = np.round(np.where(lettered, scores, 0.0), 6)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def languages(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from docs themselves."""
    return identify(docs, learn(docs, share))


@extras_aside("doc_id", "text", "lang")
def keep(docs: DataFrame, share: float = SHARE, least_score: float = LEAST_SCORE) -> DataFrame:
    """docs in a learned language by their text; others (no letter, or a score below least_score) go. lang is the prediction."""
    held = docs.sparkSession.sparkContext.broadcast(learn(docs, share))
    names = docs.columns

    def judge(batches):
        from kgspark.llm.words import slices

        filters = held.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            passes, pred = np.zeros(len(texts), bool), np.full(len(texts), None, object)
            if filters.languages:
                for first, encoded in slices([(t or "").lower() for t in texts]):
                    found = shares(filters, encoded)
                    best = found.argmax(1)
                    top = found[np.arange(len(best)), best]
                    found[np.arange(len(best)), best] = 0
                    passes[first : first + len(best)] = top * top / np.maximum(top + found.max(1), 1e-12) >= least_score
                    pred[first : first + len(best)] = [filters.languages[k] for k in best]
            passes &= np.array(batch.column("_lettered").to_pylist(), bool)
            columns = [pa.array(pred, pa.string()) if n == "lang" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(passes))

    rows = docs.withColumn("_lettered", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return rows.mapInArrow(judge, docs.schema)
