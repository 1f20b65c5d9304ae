"""Byte-level BPE by DuckDB recursive queries, one connection a Python worker.

A rank file names the tokens' bytes; two neighbouring tokens merge if their
bytes together are a token, whose rank is the merge's. Every split of a token
in two tokens is a row of the merge table.

Encoding: a text is cut into words by the pattern, words that are tokens are
done, and the batch's other new words go through one recursive query: each
word's token-position rows join the merge table, and its leftmost pair of
least rank is contracted, until no word has a pair. Words of more than
LONG_WORD bytes go through a second form of the query, which contracts the
other pairs of that rank in the same round, left to right without overlap,
unless some pair with the new token ranks lower: they'd be next in turn anyway,
so the ids are the same, in as many rounds as the word has different ranks.

Decoding: rows (part, position, id) join the vocabulary and are aggregated in
order of position.

A worker remembers the ids of words in a memo of two bounded generations, and
queries take a bounded number of words or ids at a time. A long text takes
memory in proportion to its length, a long word time in proportion to its
length times its different ranks.

Null texts are empty ones, without ids; null ids and repeated rows stay as
they are; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes from which a word's pairs of equal rank are contracted together.
LONG_WORD = 64
#: Words of a recursive query, ids of a decoding query, characters of the texts taken together.
QUERY_WORDS = 20_000
QUERY_IDS = 200_000
SLICE_CHARS = 1 << 20
#: Words in a generation of the memo, and characters of a word that it keeps.
MEMO_WORDS = 400_000
MEMO_CHARS = 64
#: Single spaces between two other characters: a word never reaches across their front.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_TWO_SPACES = re.compile(r"\s\s")
_codecs: dict[tuple[str, str], Codec] = {}

MERGES = """
    CREATE TABLE merges AS
    WITH cut AS (SELECT id AS made, code, unnest(range(2, len(code), 2)) AS at FROM vocabulary),
    pairs AS (SELECT l.id AS a, r.id AS b, made FROM cut JOIN vocabulary l ON l.code = cut.code[:cut.at] JOIN vocabulary r ON r.code = cut.code[cut.at + 1:]),
    lower AS (SELECT a AS made FROM pairs WHERE made < a UNION SELECT b FROM pairs WHERE made < b)
    SELECT a::BIGINT << 32 | b AS pair, made, lower.made IS NOT NULL AS alone FROM pairs LEFT JOIN lower USING (made)"""
_PAIRS = """(SELECT word, unnest(ids) AS a, unnest(ids[2:]) AS b, generate_subscripts(ids, 1) AS pos FROM t) p
        JOIN merges m ON m.pair = p.a::BIGINT << 32 | p.b"""
ENCODE = f"""
    WITH RECURSIVE t(word, ids) AS (
        SELECT word, ids FROM words
        UNION ALL
        SELECT t.word, t.ids[:least.at - 1] || [least.made] || t.ids[least.at + 2:]
        FROM t JOIN (SELECT word, min(made) AS made, arg_min(pos, made::BIGINT << 32 | pos) AS at FROM {_PAIRS} GROUP BY word) least USING (word))
    SELECT word, array_to_string(arg_min(ids, len(ids)), ' ') AS ids FROM t GROUP BY word"""
ENCODE_LONG = f"""
    WITH RECURSIVE t(word, ids) USING KEY (word) AS (
        SELECT word, ids FROM words
        UNION
        (WITH found AS (SELECT word, pos, made, alone FROM {_PAIRS}),
        least AS (SELECT word, min(made) AS made FROM found GROUP BY word),
        hit AS (SELECT word, pos, made, alone, row_number() OVER (PARTITION BY word ORDER BY pos) AS nth FROM found JOIN least USING (word, made)),
        turn AS (SELECT *, row_number() OVER (PARTITION BY word, pos - nth ORDER BY pos) AS turn FROM hit),
        cut AS (SELECT word, pos, made FROM turn WHERE CASE WHEN alone THEN nth = 1 ELSE turn % 2 = 1 END),
        tokens AS (SELECT word, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM t SEMI JOIN least USING (word)),
        kept AS (SELECT word, pos, coalesce(cut.made, id) AS id FROM tokens LEFT JOIN cut USING (word, pos))
        SELECT word, list(id ORDER BY pos) FROM kept ANTI JOIN (SELECT word, pos + 1 AS pos FROM cut) USING (word, pos) GROUP BY word))
    SELECT word, array_to_string(ids, ' ') AS ids FROM t"""
DECODE = """
    SELECT part, string_agg(code, '') AS code
    FROM (SELECT part, pos, code FROM tokens JOIN vocabulary USING (id) ORDER BY part, pos) GROUP BY part"""


def codec(ranks: str, pattern: str) -> Codec:
    """This worker's codec; its memo outlives a task."""
    if (ranks, pattern) not in _codecs:
        _codecs[ranks, pattern] = Codec(ranks, pattern)
    return _codecs[ranks, pattern]


class Codec:
    def __init__(self, ranks: str, pattern: str):
        import duckdb
        import regex

        with open(ranks, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.first = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.words = regex.compile(pattern).findall
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
        self.db.register("ranks", pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "token": pa.array(self.ranks, pa.binary())}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT id, lower(hex(token)) AS code FROM ranks ORDER BY id")
        self.db.unregister("ranks")
        self.db.execute(MERGES)
        #: What stands behind a single space (by its text without it), and words that stand elsewhere; ids as decimals.
        self.behind, self.plain = _Memo(), _Memo()

    def encode(self, texts: Iterable[str | None]) -> list[str]:
        """Each text's ids as decimals with one space between."""
        cut = [self._cut(t or "") for t in texts]
        self._learn(cut)
        behind, plain, out = self.behind.__getitem__, self.plain.__getitem__, []
        for first, rest in cut:
            ids = list(map(behind, rest))
            out.append(" ".join([plain(first), *ids] if first else ids))
        self.behind.turn()
        self.plain.turn()
        return out

    @staticmethod
    def _cut(text: str) -> tuple[str, list[str]]:
        """What stands before the first cut, and what stands behind the spaces that no word reaches across."""
        first, *rest = _CUT.split(text) if _TWO_SPACES.search(text) else text.split(" ")
        return first, rest

    def _learn(self, cut: list[tuple[str, list[str]]]) -> None:
        """Put all that the memo lacks of these texts into it."""
        lead = self.plain.missing({first for first, _ in cut if first})
        chunks = [(self.plain, chunk, self.words(chunk)) for chunk in lead]
        chunks += [(self.behind, chunk, self.words(" " + chunk)) for chunk in self.behind.missing(set().union(*(rest for _, rest in cut)))]
        new = dict.fromkeys(w for _, _, words in chunks for w in words)
        spaced = {w[1:]: w for w in new if w[0] == " "}
        for memo, words in ((self.behind, spaced), (self.plain, {w: w for w in new if w[0] != " "})):
            keys = list(memo.missing(set(words)))
            memo.update(zip(keys, self._merged([words[k] for k in keys]), strict=True))
        behind, plain = self.behind, self.plain
        for memo, chunk, words in chunks:
            memo[chunk] = " ".join([behind[w[1:]] if w[0] == " " else plain[w] for w in words])

    def _merged(self, words: list[str]) -> list[str]:
        """The words' ids, in order: whole tokens at once, the others by the recursive queries."""
        coded = [w.encode() for w in words]
        out = ["" if (rank := self.ranks.get(c)) is None else str(rank) for c in coded]
        open_ = [i for i, ids in enumerate(out) if not ids]
        long = [i for i in open_ if len(coded[i]) > LONG_WORD]
        short = [i for i in open_ if len(coded[i]) <= LONG_WORD]
        for query, some in [(ENCODE_LONG, long), *((ENCODE, short[k : k + QUERY_WORDS]) for k in range(0, len(short), QUERY_WORDS))]:
            if some:
                ends = np.cumsum([0, *(len(coded[i]) for i in some)])
                ids = self.first[np.frombuffer(b"".join(coded[i] for i in some), np.uint8)]
                rows = self._asked(query, words=pa.table({"word": pa.array(some, pa.int32()), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))}))
                for i, found in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                    out[i] = found
        return out

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids. An id outside the vocabulary is an error."""
        sizes = [len(x) for x in ids]
        flat = np.concatenate([np.empty(0, np.int32), *ids]).astype(np.int32)
        part = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        out, done = [[] for _ in ids], 0
        for at in range(0, len(flat), QUERY_IDS):
            some = slice(at, at + QUERY_IDS)
            tokens = pa.table({"part": part[some], "pos": np.arange(len(flat[some]), dtype=np.int32), "id": flat[some]})
            rows = self._asked(DECODE, tokens=tokens)
            for i, code in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                out[i].append(bytes.fromhex(code))
                done += len(code)
        lengths = {i: len(token) for token, i in self.ranks.items()}
        if done != 2 * sum(lengths[i] * n for i, n in zip(*map(np.ndarray.tolist, np.unique(flat, return_counts=True)), strict=True)):
            raise ValueError("decoding lost tokens")
        return [b"".join(x) for x in out]

    def _asked(self, query: str, **tables: pa.Table) -> pa.Table:
        for name, table in tables.items():
            self.db.register(name, table)
        try:
            return self.db.sql(query).to_arrow_table()
        finally:
            for name in tables:
                self.db.unregister(name)


class _Memo(dict):
    """word -> ids, in two generations of bounded size."""

    def __init__(self):
        self.old = {}

    def missing(self, words: set[str]) -> list[str]:
        """The words of which neither generation knows; the older one's go into this one."""
        lacking = words.difference(self)
        known = [w for w in lacking if w in self.old]
        self.update(zip(known, map(self.old.__getitem__, known), strict=True))
        return list(lacking.difference(known))

    def turn(self) -> None:
        """Between two batches: drop what is too long to keep, and the older generation if this one is full."""
        if len(self) >= MEMO_WORDS:
            self.old = {k: v for k, v in self.items() if len(k) <= MEMO_CHARS}
            self.clear()


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches, cut where the text of a slice would pass SLICE_CHARS."""
    for batch in batches:
        sizes = np.asarray(batch.column(column).fill_null("").cast(pa.large_string()).to_numpy(zero_copy_only=False), object)
        total, at = 0, 0
        for i, text in enumerate(sizes):
            if i > at and total + len(text) > SLICE_CHARS:
                yield batch.slice(at, i - at)
                total, at = 0, i
            total += len(text)
        if batch.num_rows > at:
            yield batch.slice(at)


def encode(docs: DataFrame, ranks: str, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, ids array<int> of each row's text."""

    def run(batches):
        for batch in _slices(batches, "text"):
            found = [np.fromstring(x, np.int32, sep=" ") for x in codec(ranks, pattern).encode(batch.column("text").to_pylist())]
            ends = np.cumsum([0, *map(len, found)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *found])))
            yield pa.RecordBatch.from_arrays([batch.column("id"), ids], names=[id, "ids"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"`{id}` {kind}, ids array<int>")


def decode(rows: DataFrame, ranks: str, pattern: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """id, bytes of each row's list of ids; a null list is an empty one."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = codec(ranks, pattern).decode([np.array(x or [], np.int32) for x in part.column("ids").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found, pa.binary())], names=[id, "bytes"])

    kind = rows.schema[id].dataType.simpleString()
    return rows.select(F.col(id).alias("id"), F.col(ids).alias("ids")).mapInArrow(run, f"`{id}` {kind}, bytes binary")


def digest(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, and its ids decoded, in one pass."""

    def run(batches):
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in _slices(batches, "text"):
            own = codec(ranks, pattern)
            said = own.encode(batch.column("text").to_pylist())
            ids = [np.fromstring(x, np.int32, sep=" ") for x in said]
            columns = [pa.array(list(map(len, ids)), pa.int64()), pa.array([sha(x.encode()) for x in said]), pa.array(list(map(sha, own.decode(ids))))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
