"""Viterbi as a fold against all tag paths, unknown words by their endings, and terms without a qualifying first word."""

import itertools
import math

import pytest

from kgspark.operators import tagging

SAMPLE = """the/DT old/JJ man/NN boats/VBZ
the/DT old/NN man/VBP the/DT boats/NNS
severe/JJ chronic/JJ pain/NN hurts/VBZ
very/RB severe/JJ pain/NN
a/DT painful/JJ joint/NN aches/VBZ badly/RB
liver/NN disease/NN hurts/VBZ
people/NNS man/VBP the/DT pumps/NNS
patients/NNS with/IN grade/NN 3/CD toxicity/NN
an/DT acute/JJ infection/NN ends/VBZ slowly/RB
patients/NNS run/VBP quickly/RB
kidney/NN failure/NN with/IN a/DT harmful/JJ reaction/NN"""


@pytest.fixture(scope="module")
def model(spark):
    rows = [(s, p, *w.rsplit("/", 1)) for s, line in enumerate(SAMPLE.split("\n")) for p, w in enumerate(line.split())]
    m = tagging.fit(spark.createDataFrame(rows, "sentence int, pos int, word string, tag string"))
    return tagging.Model(*(df.cache() for df in m))


def tags_of(spark, model, *sentences):
    rows = [(k, s.split() if s is not None else None, "clash") for k, s in enumerate(sentences)]
    out = {r.id: r.tags for r in tagging.tag(spark.createDataFrame(rows, "id int, words array<string>, tags string"), "id", "words", model).collect()}
    return [out[k] for k in range(len(sentences))]


def test_known_ambiguous_and_unknown_words(spark, model):
    found = tags_of(spark, model, "the old man boats", "people man the pumps", "Severe joint pain", "hopeful joint", "the unmarkedly", "", None, "grade 77 toxicity")
    assert found[0] == ["DT", "JJ", "NN", "VBZ"] and found[1] == ["NNS", "VBP", "DT", "NNS"]  # man: a noun, then a verb
    assert found[2] == ["JJ", "NN", "NN"]
    assert found[3][0] == "JJ" and found[4][1] == "RB"  # by their endings
    assert found[5] == found[6] == [] and found[7][1] == "CD"


def test_fold_finds_the_best_of_all_paths(spark, model):
    words = {r.form: {t["tag"]: t["chance"] for t in r.tags} for r in model.words.collect()}
    behind, floor = model.behind.first()
    sentences = ["the man man the boats", "old old man", "the pain hurts the old man", "a grade 3 pain with a man"]
    for sentence, mine in zip(sentences, tags_of(spark, model, *sentences)):
        options = [words[w] for w in sentence.split()]

        def score(path):
            return sum(o[t] for o, t in zip(options, path)) + sum(behind.get(f"{a} {b}", floor) for a, b in itertools.pairwise([tagging.START, *path]))

        best = max(score(p) for p in itertools.product(*options))
        assert math.isclose(score(mine), best, rel_tol=1e-12)


def test_terms_without_a_qualifying_first_word(spark, model):
    terms = spark.createDataFrame([(1, "severe liver disease"), (2, "liver disease"), (3, "the kidney"), (4, "severe"), (5, "harmful reaction"), (6, None), (7, "Very  severe pain")], "id int, term string")
    out = {r.id: r.rest for r in tagging.qualified(terms, "id", "term", model).collect()}
    assert out == {1: "liver disease", 2: None, 3: "kidney", 4: None, 5: "reaction", 6: None, 7: "severe pain"}
