import math
import random
from collections import Counter

import pytest

from kgspark.operators import linking
from tests.plans_rows import most_rows


def plain(docs, asked, max_df, least, digits):
    """Rows that share an id are one document; the most similar of each query, by its least id."""
    tf = {}
    for i, words in docs:
        tf.setdefault(i, Counter()).update(words or [])
    df = Counter(t for c in tf.values() for t in c)
    idf = {t: math.log((1 + len(docs)) / (1 + n)) + 1 for t, n in df.items() if n <= max_df * len(docs)}

    def unit(c):
        w = {t: n * idf[t] for t, n in c.items() if t in idf}
        size = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / size for t, x in w.items()}

    rows, out = {i: unit(c) for i, c in tf.items()}, []
    for q, words in asked:
        x = unit(Counter(words))
        scores = [(-round(sum(v * w.get(t, 0.0) for t, v in x.items()), digits), i) for i, w in rows.items() if i is not None]
        if scores and -min(scores)[0] >= least:
            out.append((q, min(scores)[1], -min(scores)[0]))
    return sorted(out)


@pytest.mark.parametrize("held, block, chunk", [(2**17, 2**19, 2**18), (3, 20, 10), (0, 2**19, 1)])
@pytest.mark.parametrize("parts", [False, True])
def test_most_similar_matches_plain_cosines(spark, monkeypatch, held, block, chunk, parts):
    for name, value in (("HELD", held), ("BLOCK", block), ("CHUNK", chunk)):
        monkeypatch.setattr(linking, name, value)
    r = random.Random(9)
    text = lambda n: [r.choice("aabbcdefghijk") for _ in range(n)]
    docs = [(k, text(r.randint(0, 30))) for k in range(60)] + [(7, text(9)), (7, text(3)), (61, None), (62, []), (63, ["z"] * 5)]
    docs += [(70 + k, ["c", "d", "e"]) for k in range(5)]  # ties
    asked = [(k, text(r.randint(1, 6))) for k in range(20)] + [(20, ["c", "d", "e"]), (21, ["never"])]
    table, wanted = spark.createDataFrame(docs, "id long, words array<string>"), spark.createDataFrame([(q, t, n) for q, ws in asked for t, n in Counter(ws).items()], "q long, term string, tf long")
    raw, lengths, idf = linking.tf_idf_parts(table, "id", "words", 0.9)
    rows, by = (raw, lengths) if parts else (linking.tf_idf(table, "id", "words", 0.9)[0], None)
    found = linking.most_similar(linking.weighted(wanted, idf, "q"), rows, "q", "id", 0.05, 4, by).collect()
    assert sorted((x.q, x.id, x.score) for x in found) == plain(docs, asked, 0.9, 0.05, 4)


def test_no_row_for_each_query_and_row(spark):
    """300 queries and 1,000 rows of one term in common: once there was a row for each pair."""
    docs = spark.createDataFrame([(k, ["a", f"b{k}"]) for k in range(1000)] + [(1000 + k, ["c"]) for k in range(200)], "id long, words array<string>")
    raw, lengths, idf = linking.tf_idf_parts(docs, "id", "words")
    asked = spark.createDataFrame([(k, "a", 1) for k in range(300)], "q long, term string, tf long")
    found = linking.most_similar(linking.weighted(asked, idf, "q"), raw, "q", "id", 0.05, 4, lengths)
    assert most_rows(found) < 50_000
    assert {(x.q, x.id) for x in found.collect()} == {(k, 0) for k in range(300)}
