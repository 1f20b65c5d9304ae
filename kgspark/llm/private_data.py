"""PII by patterns, and information-theoretic sanitisation of the terms that reveal it.

Base kinds (email, ip, card, phone) are found by pattern. Their values are the
protected entities. A term (a lower-cased word outside all base spans, anywhere in a text
that mentions the entity) reveals an entity e by the pointwise mutual information of the two
over documents, PMI(e, t) = log2(N n(e, t) / (n(e) n(t))); as a part of the
entity's own information log2(N / n(e)) it is 1 for a term that occurs with e
alone. N and all n count different texts, whatever the number of their copies.
Of an entity that every text holds there is nothing to reveal: its terms score
0. A term found with e in at least SUPPORT different texts and
revealing at least DISCLOSED of it is a span of kind `term` wherever it stands,
in texts without the entity too.

Entities that the same texts name (a directory's) are counted as one class.

Null texts are empty; documents of equal text are one for terms; repeated rows give repeated results; an empty table none. Other columns are
ignored by digest() and kept by sanitised().
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm.extras import extras_aside
from kgspark.session import written

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 2
DISCLOSED = 0.9
#: Bits of the filters that name the entities and the terms to look for, as powers of two: 128 a value within these bounds; a value sets two.
FILTER_BITS = (16, 27)
#: Parts into which the places of a term are dealt, so that a frequent one is no single task's work.
SALT = 16
#: Every so-manieth text is read for a first count of terms, which rules out frequent ones before all texts are read; powers of two.
PARTS = (64, 8)
#: Terms of single texts that a task holds before it sends their counts.
HELD_TERMS = 1 << 20

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Where a match starts at a run of digits, it starts at the first: what can't match from there can't from within.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _emails(text: str):
    """Leftmost matches of the email pattern: one can start at a run before an @ alone."""
    low = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > low and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _EMAIL.match(text, begin) if begin < at else None
        if m:
            yield m.span()
            low = m.end()
        at = text.find("@", max(at + 1, low))


def _digits(s: str) -> list[int]:
    return [ord(c) - 48 for c in s if "0" <= c <= "9"]


def luhn(digits: list[int]) -> bool:
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; places in code points."""
    out = [("email", *span) for span in _emails(text)]
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _filter(rows: DataFrame, key: str) -> np.ndarray:
    """A table of bits, in words of 64: those set that the first and the last bits of a key name. It grows with the rows."""
    n = max(min(math.ceil(math.log2(128 * rows.count() + 1)), FILTER_BITS[1]), FILTER_BITS[0])
    ends = F.array(F.shiftrightunsigned(key, 64 - n), F.col(key).bitwiseAND(F.lit((1 << n) - 1)))
    bits = rows.select(F.explode(ends).alias("place")).select(F.shiftright("place", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
    found = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (n - 6), np.uint64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return table


def _let_through(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the filter may name."""
    out, n = np.ones(len(hashes), bool), len(table).bit_length() + 5
    for place in (hashes >> np.uint64(64 - n), hashes & np.uint64((1 << n) - 1)):
        out &= (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def _entity(kind: str, value: str) -> int:
    return _hash(f"{kind}:{value}")


def _free(text: str, spans: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, free) of a text's words; those that overlap no base span are free."""
    places = np.array([m.span() for m in _WORD.finditer(text)], np.int64).reshape(-1, 2)
    first, last = np.ascontiguousarray(places[:, 0]), np.ascontiguousarray(places[:, 1])
    free = np.ones(len(places), bool)
    for _, start, end in spans:
        free[np.searchsorted(last, start, "right") : np.searchsorted(first, end, "left")] = False
    return first, last, free


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, text_hash."""
    text = F.coalesce("text", F.lit("")).alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).withColumn("text_hash", F.xxhash64("text"))


FOUND = "doc_id long, text_hash long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, entities array<long>"


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts, digest and spans of the base kinds, and the entities it names."""

    def find(batches):
        for batch in batches:
            rows = []
            for doc_id, text_hash, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text")), strict=True):
                spans = base_spans(text)
                entities = sorted({_entity(k, text[a:b]) for k, a, b in spans})
                line = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
                counts = [sum(s[0] == k for s in spans) for k in KINDS]
                rows.append((doc_id, text_hash, *counts, hashlib.sha256(line.encode()).hexdigest(), line, entities))
            columns = list(zip(*rows, strict=True)) or [[]] * 9
            types = [pa.int64()] * 6 + [pa.string(), pa.string(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "text_hash", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "entities"])

    return _texts(docs).mapInArrow(find, FOUND)


def _mentioning(texts: DataFrame, wanted) -> DataFrame:
    """(text_hash, terms): once each, the texts that name entities which the filter lets through, with all their terms."""

    def read(batches):
        from kgspark.llm.words import word_hashes

        table, done = wanted.value, set()
        for batch in batches:
            keys, terms = [], []
            for key, text in zip(batch.column("text_hash").to_pylist(), batch.column("text").to_pylist(), strict=True):
                spans = base_spans(text) if key not in done else []
                named = np.unique(np.array([_entity(k, text[a:b]) for k, a, b in spans], np.int64))
                if not _let_through(table, named.view(np.uint64)).any():
                    continue
                if len(done) > 200_000:
                    done.clear()
                done.add(key)
                hashes = word_hashes([text.encode("utf-8", "surrogatepass")])[0]
                keys.append(key)
                terms.append(np.unique(hashes[_free(text, spans)[2]]).view(np.int64))
            if keys:
                ends = pa.array(np.cumsum([0, *map(len, terms)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(terms)))], names=["text_hash", "terms"])

    once = texts.select("text_hash", "text").mapInArrow(read, "text_hash long, terms array<long>")
    return once.groupBy("text_hash").agg(F.first("terms").alias("terms"))


def _row() -> Column:
    """A hash of a row's text and doc_id."""
    return F.xxhash64("text_hash", "doc_id").alias("row")


def _is_read(repeated: np.ndarray, first: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which rows are read: all of texts that `repeated` doesn't name, of the others those that `first` names."""
    return ~_let_through(repeated, keys.view(np.uint64)) | _let_through(first, rows.view(np.uint64))


def _first_rows(found: DataFrame, copies: DataFrame) -> tuple:
    """(repeated, first, unsure): filters of repeated texts, of their first rows, and of texts of which these two have not one row read."""
    context = found.sparkSession.sparkContext
    repeated, first = context.broadcast(_filter(copies, "text_hash")), context.broadcast(_filter(copies, "row"))

    def read(batches):
        for batch in batches:
            keys, rows = (batch.column(c).to_numpy() for c in ("text_hash", "row"))
            named = _let_through(repeated.value, keys.view(np.uint64))
            n = _is_read(repeated.value, first.value, keys, rows)[named].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys[named]), pa.array(n)], names=["text_hash", "n"])

    n_read = found.select("text_hash", _row()).mapInArrow(read, "text_hash long, n long").groupBy("text_hash").agg(F.sum("n").alias("n"))
    unsure = written(n_read.where("n <> 1").select("text_hash"), "private-unsure")
    return repeated, first, context.broadcast(_filter(unsure, "text_hash"))


def _document_counts(texts: DataFrame, wanted, repeated, first, unsure) -> DataFrame:
    """(term, n_term): different texts that hold each term which the filter lets through.

    A text counts where its first row is read, a task's texts together. Texts
    that `unsure` names are sent one by one, and count once each.
    """

    def count(batches):
        from kgspark.llm.words import slices, word_hashes

        table, done, alone, held = wanted.value, set(), [], 0

        def summed():
            terms, n = np.unique(np.concatenate(alone), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.nulls(len(terms), pa.int64()), pa.array(terms.view(np.int64)), pa.array(n)], names=["text_hash", "term", "n"])

        for batch in batches:
            keys, ids = (batch.column(c).to_numpy() for c in ("text_hash", "row"))
            single = ~_let_through(unsure.value, keys.view(np.uint64))
            read = ~single | _is_read(repeated.value, first.value, keys, ids)
            batch, keys, single, one = batch.filter(pa.array(read)), keys[read], single[read], []
            for low, encoded in slices(batch.column("text").to_pylist()):
                hashes, ends = word_hashes(encoded)
                asked = _let_through(table, hashes)
                for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True), low):
                    if not single[i]:
                        if keys[i] in done:
                            continue
                        if len(done) > 200_000:
                            done.clear()
                        done.add(keys[i])
                    terms = np.unique(hashes[a:b][asked[a:b]])
                    if single[i]:
                        alone.append(terms)
                        held += len(terms)
                    elif len(terms):
                        one.append((np.full(len(terms), keys[i]), terms))
                if held > HELD_TERMS:
                    yield summed()
                    alone, held = [], 0
            if one:
                names, terms = (np.concatenate(c) for c in zip(*one, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(terms.view(np.int64)), pa.array(np.ones(len(terms), np.int64))], names=["text_hash", "term", "n"])
        if held:
            yield summed()

    counted = texts.select("text_hash", _row(), "text").mapInArrow(count, "text_hash long, term long, n long").repartition("term")
    n = F.when(F.col("text_hash").isNull(), F.sum("n")).otherwise(F.max("n"))
    return counted.groupBy("term", "text_hash").agg(n.alias("n")).groupBy("term").agg(F.sum("n").alias("n_term"))


def _classes(docs: DataFrame, found: DataFrame, support: int, disclosed: float) -> tuple[DataFrame, DataFrame]:
    """(entities(entity, n_entity, one, two), disclosed(one, two, term, disclosure)).

    Entities that the same texts name are one class, known by two sums of
    those texts' hashes: all its entities reveal the same. Terms are counted
    with classes, so a directory of many entities meets its words once.
    """
    context, texts = docs.sparkSession.sparkContext, _texts(docs)
    pairs = found.select("text_hash", F.explode("entities").alias("entity")).distinct()
    sum_of = lambda k: F.bit_xor(F.xxhash64(F.lit(k), "text_hash"))
    alone = pairs.groupBy("entity").agg(F.count("*").alias("n_entity"), sum_of(1).alias("one"), sum_of(2).alias("two")).where(F.col("n_entity") >= support)
    alone = written(alone, "private-entities")
    named = pairs.join(alone, "entity").select("text_hash", "one", "two", "n_entity").distinct()
    mentioned = written(_mentioning(texts, context.broadcast(_filter(alone, "entity"))), "private-mentions")
    met = named.join(mentioned, "text_hash")
    together = met.select("one", "two", "n_entity", F.explode("terms").alias("term")).groupBy("one", "two", "n_entity", "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= support)
    copies = found.groupBy("text_hash").agg(F.count("*").alias("rows"), F.min(_row()).alias("row")).where("rows > 1")
    copies = written(copies, "private-copies")
    n = found.count() - (copies.agg(F.sum(F.col("rows") - 1)).first()[0] or 0)

    def share(n_term) -> Column:
        pmi = F.log2(F.lit(float(n)) * F.col("n_both") / (F.col("n_entity") * n_term))
        return F.when(F.col("n_entity") < n, pmi / F.log2(F.lit(float(n)) / F.col("n_entity"))).otherwise(0.0)

    # A term is in as many texts at least as name entities and hold it, or as hold it in a part of all texts: pairs that this rules out needn't be counted further.
    least = mentioned.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("least")).where(F.col("least") >= support)
    possible = share(F.col("least")) >= disclosed - 1e-9
    together = written(together.join(least, "term").where(possible), "private-candidates")
    once = _first_rows(found, copies)
    for part in PARTS:
        wanted = context.broadcast(_filter(together.select("term").distinct(), "term"))
        counts = _document_counts(texts.where(F.col("text_hash").bitwiseAND(F.lit(part - 1)) == 0), wanted, *once)
        together = together.join(counts, "term", "left").withColumn("least", F.greatest("least", "n_term")).drop("n_term")
        together = written(together.where(possible), "private-candidates")
        wanted.unpersist()
    wanted = context.broadcast(_filter(together.select("term").distinct(), "term"))
    both = together.join(_document_counts(texts, wanted, *once), "term").withColumn("disclosure", share(F.col("n_term")))
    return alone, both.where(F.col("disclosure") >= disclosed).select("one", "two", "term", "disclosure")


def revealing(docs: DataFrame, found: DataFrame, support: int = SUPPORT, disclosed: float = DISCLOSED) -> DataFrame:
    """(entity, term, disclosure) of the pairs above the threshold, from scan()'s rows and all documents."""
    entities, pairs = _classes(docs, found, support, disclosed)
    return entities.join(pairs, ["one", "two"]).select("entity", "term", "disclosure")


def revealing_terms(docs: DataFrame, found: DataFrame, support: int = SUPPORT, disclosed: float = DISCLOSED) -> DataFrame:
    """(term): the terms that reveal some entity, without a line for each such entity."""
    return _classes(docs, found, support, disclosed)[1].select("term").distinct()


def _places(texts: DataFrame, wanted) -> DataFrame:
    """(doc_id, text_hash, term, start, stop): the words outside base spans which the filter lets through."""

    def look(batches):
        from kgspark.llm.words import slices, word_hashes

        table = wanted.value
        for batch in batches:
            texts, rows, found = batch.column("text").to_pylist(), [], []
            for low, encoded in slices(texts):
                hashes, ends = word_hashes(encoded)
                asked = _let_through(table, hashes)
                held = np.concatenate([[0], np.cumsum(asked)])[ends]
                for i in np.flatnonzero(held[1:] > held[:-1]).tolist():
                    text, mine = texts[low + i], slice(ends[i], ends[i + 1])
                    start, stop, free = _free(text, base_spans(text))
                    at = np.flatnonzero(asked[mine] & free)
                    rows.append(np.full(len(at), low + i))
                    found.append((hashes[mine][at].view(np.int64), start[at], stop[at]))
            if rows:
                part = batch.select(["doc_id", "text_hash"]).take(pa.array(np.concatenate(rows)))
                columns = [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=["doc_id", "text_hash", "term", "start", "stop"])

    return texts.select("doc_id", "text_hash", "text").mapInArrow(look, "doc_id long, text_hash long, term long, start long, stop long")


def _term_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, text_hash, terms): array of (start, stop) of revealing terms, by start, in all documents."""
    terms = written(revealing_terms(docs, found), "private-terms")
    wanted = docs.sparkSession.sparkContext.broadcast(_filter(terms, "term"))
    places = _places(_texts(docs), wanted).withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash", "start"), F.lit(SALT)))
    salted = terms.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    hits = places.join(salted, ["term", "salt"]).select("doc_id", "text_hash", "start", "stop").distinct()
    return hits.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("terms"))


def _with_terms(docs: DataFrame) -> DataFrame:
    found = written(scan(docs), "private-scan")
    terms = _term_spans(docs, found).withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
    joined = found.join(terms, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    line = F.array_join(F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["start"].cast("string"), t["stop"].cast("string"))), ",")
    parts = F.array(F.when(F.col("spans") != "", F.col("spans")), F.when(F.size("terms") > 0, line))
    return joined.withColumn("spans", F.array_join(F.array_compact(parts), ",")).drop("d", "h", "entities", "terms")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base kinds, all spans as kind:start:end, and n_private: values of all base kinds together."""
    return _with_terms(docs).drop("text_hash").withColumn("n_private", F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone"))


@extras_aside("doc_id", "text")
def sanitised(docs: DataFrame) -> DataFrame:
    """docs with base values generalised to their kind ([EMAIL]) and revealing terms removed ([TERM])."""
    spans = _with_terms(docs).where("spans <> ''").select(F.col("doc_id").alias("_pii_doc"), F.col("text_hash").alias("_pii_hash"), F.col("spans").alias("_pii_spans")).distinct()
    match = F.col("doc_id").eqNullSafe(F.col("_pii_doc")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_pii_hash"))

    names = docs.columns

    def replaced(batches):
        for batch in batches:
            out = []
            for text, line in zip(batch.column("text").to_pylist(), batch.column("_pii_spans").to_pylist(), strict=True):
                at, parts = 0, []
                for start, end, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in (line or "").split(",") if s)):
                    if start >= at:
                        parts += [text[at:start], f"[{kind.upper()}]"]
                    at = max(at, end)
                out.append(text if not parts else "".join(parts) + text[at:])
            columns = [pa.array(out, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.join(spans, match, "left").mapInArrow(replaced, docs.schema)
