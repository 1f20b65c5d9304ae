import math
import random
import re
from collections import defaultdict

import pytest

from kgspark.llm import private_data


def spans_of(spark, rows):
    return {r.doc_id: r.spans for r in private_data.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_copies_of_a_text_count_once(spark):
    rows = [(k, f"note {k % 2} of zarkon from z@ex.org") for k in range(600)]
    rows += [(1000 + k, f"note {k} of nobody from nowhere") for k in range(2, 400)]
    spans = spans_of(spark, rows)
    assert all(spans[k] == "email:22:30,term:10:16" for k in range(600))
    assert not any(spans[1000 + k] for k in range(2, 400))


def test_an_entity_of_every_text_has_no_terms(spark):
    spans = spans_of(spark, [(k, f"note {k} of zarkon from z@ex.org") for k in range(5)])
    assert set(spans.values()) == {"email:22:30"}


def test_terms_are_found_and_marked_at_any_distance(spark):
    far = " ".join(f"w{k}" for k in range(50))
    rows = [(k, f"zarkon {far} note {k} from z@ex.org and zarkon") for k in range(30)]
    rows += [(100, "Zarkon alone"), (101, "nothing here")]
    rows += [(1000 + k, f"{far} note {k} from nobody and nothing here alone") for k in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in private_data.digest(docs).collect()}
    for k in range(30):
        text = rows[k][1]
        at, last = text.index("z@"), text.rindex("zarkon")
        assert spans[k] == f"email:{at}:{at + 8},term:0:6,term:{last}:{last + 6}"
    assert spans[100] == "term:0:6" and spans[101] == spans[1000] == ""
    assert {r.text for r in private_data.sanitised(docs).where("doc_id = 100").collect()} == {"[TERM] alone"}


def test_directories_of_many_entities(spark):
    """Two texts with the same 50,000 mails and words of their own, and a third with some of them: no line per mail and word."""
    mails = [f"m{k}@ex.org" for k in range(50_000)]
    words = [f"word{k}" for k in range(5000)]
    both = " ".join(x for k, m in enumerate(mails) for x in ([words[k // 10], m] if k % 10 == 0 else [m]))
    rows = [(1, both + " one"), (2, both + " two"), (3, " ".join(mails[:100]) + " word3"), *((10 + k, f"nothing {k} here") for k in range(200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = private_data.scan(docs)
    entities, pairs = private_data._classes(docs, found, 2, 0.9)
    assert entities.select("one", "two").distinct().count() == 2 and entities.count() == 50_000
    assert pairs.count() == 2 * 5000  # a line per class and word
    assert private_data.revealing_terms(docs, found).count() == 5000
    spans = {r.doc_id: r.spans for r in private_data.digest(docs).collect()}
    assert spans[1].count("term:") == 5000 and spans[3].count("term:") == 1 and spans[10] == ""


def test_sanitised_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, terms string")
    assert private_data.sanitised(docs).count() == 0 and private_data.sanitised(docs).columns == docs.columns


def _plain_disclosures(texts):
    """{(entity, term): disclosure} of different texts, by the module's definition."""
    of_entity, of_term = defaultdict(set), defaultdict(set)
    for text in texts:
        spans = private_data.base_spans(text)
        for kind, a, b in spans:
            of_entity[kind, text[a:b]].add(text)
        for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
            if not any(a < m.end() and m.start() < b for _, a, b in spans):
                of_term[m[0].lower()].add(text)
    n, out = len(texts), {}
    for e, held in of_entity.items():
        for t, holding in of_term.items():
            if len(held & holding) >= 2:
                out[e, t] = math.log2(n * len(held & holding) / (len(held) * len(holding))) / math.log2(n / len(held))
    return out


@pytest.mark.parametrize("bits", [(16, 27), (10, 10), (7, 7)])
def test_copies_count_once_whatever_their_ids_and_however_small_the_filters(spark, monkeypatch, bits):
    """Copies with ids of their own, with one id, and without ids; filters that are nearly full let more through, and change nothing."""
    monkeypatch.setattr(private_data, "FILTER_BITS", bits)
    draw = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join([*draw.sample(words[k % 7 * 8 :], 6), f"m{k % 11}@ex.org" if k % 3 == 0 else "none"]) for k in range(200)]
    rows = [(k, text) for k, text in enumerate(texts)]
    rows += [(1000 + k, text) for k, text in enumerate(texts[:40])] + [(2000 + k, text) for k, text in enumerate(texts[:20])]
    rows += [(k, texts[k]) for k in range(30, 60)] + [(None, texts[k]) for k in range(50, 80)] * 2
    draw.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = private_data.scan(docs)
    entity = {private_data._entity("email", f"m{k}@ex.org"): ("email", f"m{k}@ex.org") for k in range(11)}
    got = sorted((entity[r.entity], round(r.disclosure, 9)) for r in private_data.revealing(docs, found, 2, 0.1).collect())
    expected = sorted((e, round(x, 9)) for (e, _), x in _plain_disclosures(set(texts)).items() if x >= 0.1)
    assert len(expected) > 50 and got == expected


def test_words_of_copied_texts_are_not_sent_text_by_text(spark):
    """300 texts of 1,000 words that an entity's texts hold, each twice: what is shuffled follows the words, not the texts."""
    draw = random.Random(4)
    words = [f"word{k}" for k in range(3000)]
    texts = [" ".join(draw.sample(words, 1000)) for _ in range(300)]
    rows = [(k, " ".join(words) + f" z@ex.org {k}") for k in (1, 2)]
    rows += [(10 + k, text) for k, text in enumerate(texts * 2)] + [(1000 + k, f"nothing {k}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = private_data.written(docs.repartition(4), "copied-texts")
    found = private_data.written(private_data.scan(docs), "copied-found")

    def stages() -> list:
        store = spark.sparkContext._jsc.sc().statusStore()
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return [found.apply(k) for k in range(found.size())]

    last = max(s.stageId() for s in stages())
    assert private_data.revealing_terms(docs, found, 2, 0.5).count() == 0
    sent = sum(s.shuffleWriteBytes() for s in stages() if s.stageId() > last)
    assert sent < 1_000_000
