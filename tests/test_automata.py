"""Vocabulary tokens against the plain substring test."""

import random

import pytest
from pyspark.sql import functions as F

from kgspark.operators import automata

DOCS = [
    (1, ["heart_failure", "rate"]),
    (2, ["a", "b", "c", "d"]),
    (3, ["a_b", "c_d"]),
    (4, []),
    (5, None),
    (None, ["failure"]),
    (6, ["a", "a", "a", "b"]),
    (6, ["a", "a", "a", "b"]),
    (7, ["failures", "", "x__y"]),
    (8, ["d", "c"] * 500 + ["long_token_of_many_words_at_the_end"]),
]
TOKENS = [("failure", 1), ("a_b_c_d", 2), ("b_c", 3), ("a_a_b", 4), ("a_a", 4), ("rate", 5), ("heart_failure_rate", 6), ("x", 7), ("", 8), ("token_of_many_words", 9), ("c_d_c_d_c", 10), (None, 11), ("a", None), ("z", 12), ("failure", 13)]


def plain(docs, tokens):
    return {(i, c) for i, words in docs if words is not None for t, c in tokens if t is not None and c is not None and f"_{t}_" in "_" + "_".join(words) + "_"}


@pytest.mark.parametrize("most", [10_000, 6])
def test_hits_are_those_of_the_substring_test(spark, most):
    docs = spark.createDataFrame([(*d, "clash") for d in DOCS], "doc long, words array<string>, cluster string")
    vocabulary = spark.createDataFrame([(*t, "clash") for t in TOKENS], "token string, cluster int, id string")
    out = automata.vocabulary_hits(docs, "doc", "words", vocabulary, most)
    assert out.columns == ["doc", "cluster"]
    found = [tuple(r) for r in out.collect()]
    assert len(found) == len(set(found)) and set(found) == plain(DOCS, TOKENS)


@pytest.mark.parametrize("most", [10_000, 40])
def test_random_vocabularies(spark, most):
    rng = random.Random(4)
    some = lambda n: [rng.choice("abc") for _ in range(n)]
    docs = [(k, ["_".join(some(rng.randint(1, 3))) for _ in range(rng.randint(0, 12))]) for k in range(150)]
    tokens = [("_".join(some(rng.randint(1, 6))), k) for k in range(60)]
    out = automata.vocabulary_hits(spark.createDataFrame(docs, "doc long, words array<string>"), "doc", "words", spark.createDataFrame(tokens, "token string, cluster int"), most)
    assert {tuple(r) for r in out.collect()} == plain(docs, tokens)


def test_nothing_to_find(spark):
    docs = spark.createDataFrame(DOCS, "doc long, words array<string>")
    vocabulary = spark.createDataFrame(TOKENS, "token string, cluster int")
    assert automata.vocabulary_hits(docs, "doc", "words", vocabulary.where("false")).count() == 0
    assert automata.vocabulary_hits(docs.where("false"), "doc", "words", vocabulary).count() == 0
    assert automata.vocabulary_hits(docs.where("false"), "doc", "words", vocabulary, 6).count() == 0


def test_many_tokens_of_one_first_word_are_cut(spark):
    tokens = [(f"a_{k}", k) for k in range(300)]
    docs = [(k, ["a", str(k), "a", str(k + 1)]) for k in range(0, 300, 50)]
    out = automata.vocabulary_hits(spark.createDataFrame(docs, "doc long, words array<string>"), "doc", "words", spark.createDataFrame(tokens, "token string, cluster int"), 50)
    assert sorted(map(tuple, out.select(F.col("doc"), "cluster").collect())) == sorted(plain(docs, tokens))
