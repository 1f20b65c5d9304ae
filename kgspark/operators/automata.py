"""Vocabulary tokens in documents by an Aho-Corasick automaton over words.

A token is a run of whole words; words that stand joined by _ (phrases) are
opened on both sides, so a token hits a document exactly if `_token_` is a part of
`_word_word_.._`. All tokens are looked for in one walk over a document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Words of all tokens of an automaton; a larger vocabulary is cut by its tokens' first words.
AUTOMATON_WORDS = 500_000
#: Tasks among which a part of a large vocabulary deals its documents.
DEALT = 16


class Automaton:
    """add() tokens as lists of words, link(), then hits(words) gives the numbers of all tokens in a document."""

    def __init__(self):
        self.next: list[dict[str, int]] = [{}]
        self.own: list[list[int]] = [[]]

    def add(self, words: list[str], number: int) -> None:
        state = 0
        for word in words:
            to = self.next[state].get(word)
            if to is None:
                to = self.next[state][word] = len(self.next)
                self.next.append({})
                self.own.append([])
            state = to
        self.own[state].append(number)

    def link(self) -> Automaton:
        """fail: the state of the longest proper suffix that is in the trie; more: the nearest such state that ends a token."""
        self.fail, self.more, front = [0] * len(self.next), [0] * len(self.next), list(self.next[0].values())
        while front:
            below = []
            for state in front:
                for word, to in self.next[state].items():
                    self.fail[to] = self._step(self.fail[state], word)
                    below.append(to)
                back = self.fail[state]
                self.more[state] = back if self.own[back] else self.more[back]
            front = below
        return self

    def _step(self, state: int, word: str) -> int:
        while state and word not in self.next[state]:
            state = self.fail[state]
        return self.next[state].get(word, 0)

    def hits(self, words: Iterable[str]) -> set[int]:
        found, state, ended = set(), 0, set()
        for word in words:
            state = self._step(state, word)
            at = state if self.own[state] else self.more[state]
            while at and at not in ended:  # what a state ends is found once
                ended.add(at)
                found.update(self.own[at])
                at = self.more[at]
        return found


def _opened(words) -> F.Column:
    """The words of an array or of a text, with joined ones taken apart."""
    return F.split(words, "_")


def _numbers(automaton: Automaton, clusters: list, batch: pa.RecordBatch, kinds: tuple[pa.DataType, pa.DataType]) -> pa.RecordBatch:
    at, out = [], []
    for k, words in enumerate(batch.column("words").to_pylist()):
        own = {clusters[n] for n in automaton.hits(words or [])}
        at += [k] * len(own)
        out += own
    return pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())).cast(kinds[0]), pa.array(out, kinds[1])], names=["id", "cluster"])


def vocabulary_hits(docs: DataFrame, id: str, words: str, vocabulary: DataFrame, most: int = AUTOMATON_WORDS) -> DataFrame:
    """(id, cluster): the clusters of the vocabulary(token, cluster) whose tokens stand in a row's array of words.

    Tokens may have any number of words. A vocabulary of at most `most` words
    is one automaton, built once and broadcast. A larger one is cut into parts by
    its tokens' first words: a document's row goes to the parts that its words
    begin, in tasks that read a part's tokens first and then walk their
    documents one by one. Null words, tokens and clusters have no hits.
    """
    spark = docs.sparkSession
    tokens = vocabulary.where("token is not null and cluster is not null").select(_opened("token").alias("words"), "cluster").distinct()
    rows = docs.where(F.col(words).isNotNull()).select(F.col(id).alias("id"), _opened(F.array_join(words, "_")).alias("words"))
    kinds = to_arrow_type(docs.schema[id].dataType), to_arrow_type(vocabulary.schema["cluster"].dataType)
    schema = ", ".join(f"`{n}` {t.simpleString()}" for n, t in ((id, docs.schema[id].dataType), ("cluster", vocabulary.schema["cluster"].dataType)))
    size = tokens.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    if size <= most:
        known = tokens.collect()  # at most `most` words
        automaton = Automaton()
        for k, token in enumerate(known):
            automaton.add(token.words, k)
        held = spark.sparkContext.broadcast((automaton.link(), [t.cluster for t in known]))

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton, clusters = held.value
            for batch in batches:
                out = _numbers(automaton, clusters, batch, kinds)
                yield out.rename_columns([id, "cluster"])

        return rows.mapInArrow(walk, schema).distinct()
    parts = -(-size // most)
    part = lambda word: F.pmod(F.xxhash64(word), F.lit(parts))
    placed = tokens.withColumn("part", part(F.col("words")[0]))
    # A part may still be large, by one first word of many tokens: it is cut by whole tokens, and its documents meet every slot.
    sizes = placed.groupBy("part").agg(F.ceil(F.sum(F.size("words")) / (2 * most)).cast("int").alias("slots"))
    slot = F.pmod(F.xxhash64("words"), F.col("slots"))
    own = placed.join(sizes, "part").select("part", slot.cast("int").alias("slot"), F.lit(None).cast(docs.schema[id].dataType).alias("id"), "words", "cluster")
    own = own.withColumn("dealt", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1)))).withColumn("is_doc", F.lit(False))
    begun = F.array_distinct(F.transform("words", part))
    asked = rows.select(F.explode(begun).alias("part"), "id", "words").join(sizes, "part")
    asked = asked.select("part", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), "id", "words").withColumn("cluster", F.lit(None).cast(vocabulary.schema["cluster"].dataType))
    asked = asked.withColumn("dealt", F.pmod(F.xxhash64("id", "words"), F.lit(DEALT)).cast("int")).withColumn("is_doc", F.lit(True))
    met = own.unionByName(asked).repartition("part", "slot", "dealt").sortWithinPartitions("part", "slot", "dealt", "is_doc")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, automaton, clusters, linked = None, Automaton(), [], False
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("part", "slot", "dealt", "is_doc")), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if keys[a][:3] != key:
                    key, automaton, clusters, linked = keys[a][:3], Automaton(), [], False
                some = batch.slice(a, b - a)
                if not keys[a][3]:
                    for words, cluster in zip(some.column("words").to_pylist(), some.column("cluster").to_pylist(), strict=True):
                        automaton.add(words, len(clusters))
                        clusters.append(cluster)
                    continue
                if not linked:
                    automaton.link()
                    linked = True
                out = _numbers(automaton, clusters, some, kinds)
                yield out.rename_columns([id, "cluster"])

    return met.mapInArrow(stream, schema).distinct()
