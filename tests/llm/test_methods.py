"""The methods themselves against plain definitions: fingerprints, language filters, disclosure, co-training, token cuts, near copies of long texts."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.llm import fingerprints, languages, near_copies, orc_tokens, private_data, quality, queries, tokens, words
from kgspark.operators.components import components

# Order MinHash


def plain_order_min_hash(text, functions=64, k=fingerprints.K, least=fingerprints.LEAST):
    """The tuples themselves, by the definition: numbered k-mers, the least of each permutation, in text order."""
    full = min(k, len(text))
    grams = [text[i : i + full] for i in range(len(text) - full + 1)]
    seen, numbered = Counter(), []
    for g in grams:
        numbered.append((g, seen[g]))
        seen[g] += 1
    hashes = fingerprints.items(fingerprints.points(text)).tolist()
    assert len({(n, h) for n, h in zip(numbered, hashes, strict=True)}) == len(set(numbered))
    out = []
    for f in fingerprints._FACTORS.tolist():
        order = sorted(range(len(grams)), key=lambda i: ((hashes[i] * f) % (1 << 32), i))[:least]
        out.append(tuple(numbered[i] for i in sorted(order)))
    return out


TEXTS = ["", "a", "abc", "abcdefgh", "aaaaaaaaaaaaaaaaaaaa", "the cat sat on the mat, the cat sat on the hat", "🙂é" * 9, " ".join(map(str, range(200)))]


def test_fingerprints_follow_the_definition():
    texts = [t for t in TEXTS if t]
    for a in texts:
        for b in [*texts, a[:-3] + "xyz", a[5:] + a[:5]]:
            same = [x == y for x, y in zip(plain_order_min_hash(a), plain_order_min_hash(b), strict=True)]
            assert (fingerprints.fingerprint(a) == fingerprints.fingerprint(b)).tolist() == same


def test_common_starts_give_the_same_fingerprints():
    r = random.Random(5)
    for _ in range(300):
        a, b = ("".join(r.choice("ab c") for _ in range(r.randint(0, 120))) for _ in range(2))
        changed, mine, its = fingerprints.with_edited(a, b)
        assert changed == fingerprints.edited(a, b)
        assert (mine == fingerprints.fingerprint(a)).all() and (its == fingerprints.fingerprint(changed)).all()


def test_likeness_estimates_without_much_spread():
    """Over many pairs of random texts with a common half, the spread is that of 64 independent draws."""
    r, found = random.Random(3), []
    for _ in range(200):
        a = "".join(r.choice("abcdefghij") for _ in range(400))
        b = a[:200] + "".join(r.choice("abcdefghij") for _ in range(200))
        found.append(fingerprints.likeness(fingerprints.fingerprint(a), fingerprints.fingerprint(b)))
    p = np.mean(found)
    assert 0.05 < p < 0.25  # both of a tuple's items lie in the common half of the union: about (1/3)^2
    assert np.std(found) < 1.5 * math.sqrt(p * (1 - p) / fingerprints.FUNCTIONS)


# language filters


def test_filters_hold_the_frequent_ngrams_and_few_others(spark):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    share = 1e-4
    filters = languages.learn(docs, share)
    grams = defaultdict(Counter)
    for r in docs.where(~languages.held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull()).collect():
        folded = bytes(b if 97 <= b <= 122 or b > 127 else 32 for b in r.text.lower().encode())
        for word_run in folded.split(b" "):
            # An n-gram has no space in its second and third byte; it may start or end with one.
            padded = b" " + word_run + b" "
            grams[r.lang].update(padded[i : i + 4] for i in range(len(padded) - 3) if word_run)
    assert filters.languages == sorted(grams)
    for k, lang in enumerate(filters.languages):
        total = sum(grams[lang].values())
        member = {g for g, n in grams[lang].items() if n >= 1.2 * share * total}
        value = np.array([int.from_bytes(g, "big") for g in sorted(member)], np.uint32)
        named = filters.words[:, 0][languages._places(value)[0]]
        for at in languages._places(value)[1:]:
            named &= filters.words[:, 0][at]
        assert len(member) > 100 and (named >> np.uint64(k) & np.uint64(1)).all()
        others = np.random.default_rng(1).integers(0, 1 << 32, 20_000, dtype=np.uint32)
        wrong = np.ones(len(others), np.uint64) << np.uint64(k)
        for at in languages._places(others):
            wrong &= filters.words[:, 0][at]
        assert np.mean(wrong > 0) <= 3 * filters.rates[k] + 0.001


# disclosure


def test_disclosures_match_brute_force(spark):
    r = random.Random(11)
    people = {f"p{k}@ex.org": f"name{k}" for k in range(12)}
    rows = []
    for k in range(400):
        mail = r.choice(list(people))
        said = [r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(6)]
        if k % 2:
            said += [mail] + ([people[mail]] if r.random() < 0.8 else []) + ([f"hobby{r.randint(0, 3)}"])
        r.shuffle(said)
        rows.append((k, " ".join(said) + f" t{k}"))
    rows += [(1000 + k, rows[1][1]) for k in range(30)]  # copies count once
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(x.entity, x.term): x.disclosure for x in private_data.revealing(docs, private_data.scan(docs), disclosed=0.3).collect()}
    texts = sorted({t for _, t in rows})
    n, n_e, n_t, n_b = len(texts), Counter(), Counter(), Counter()
    for t in texts:
        mails = {w for w in t.split() if "@" in w}
        terms = {w for w in t.split() if "@" not in w}
        n_e.update(mails)
        n_t.update(t.lower().replace("@", " @ ").split() and {w for w in t.split()})
        n_b.update((m, w) for m in mails for w in terms)
    key = lambda w: int(words.word_hashes([w.encode()])[0].view(np.int64)[0])
    wanted = {}
    for (m, w), both in n_b.items():
        score = math.log2(n * both / (n_e[m] * n_t[w])) / math.log2(n / n_e[m])
        if both >= private_data.SUPPORT and n_e[m] >= private_data.SUPPORT and score >= 0.3:
            wanted[private_data._entity("email", m), key(w)] = score
    assert found.keys() == wanted.keys() and len(wanted) >= 12
    assert all(found[k] == pytest.approx(wanted[k]) for k in wanted)


# co-training


def test_quality_of_documents_whose_labels_were_held_back(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    models = quality.train(docs, labels.where(~part))
    rows = quality.score(docs, models).join(labels.where(part), "doc_id").collect()
    for name, least in (("quality", 0.75), ("toxic", 0.65)):  # some 250 labels to learn from, 30 of them toxic
        good, bad = ([r[f"{name}_score"] for r in rows if r[name] == v] for v in (1, 0))
        assert good and bad and np.mean([np.mean([(g > b) + (g == b) / 2 for b in bad]) for g in good]) > least


def test_views_pass_each_other_what_they_are_sure_of(spark):
    r = random.Random(2)
    rows = []
    for k in range(600):
        good = k % 2
        said = " ".join(r.choice(["fine", "clear", "sound"] if good else ["awful", "vile", "rotten"]) for _ in range(12))
        rows.append((k, f"{said} {k}", "en", "press" if good else "forum"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(k, k % 2, 1 - k % 2) for k in range(300)], "doc_id long, quality int, toxic int")
    scored = quality.classify(docs, labels).collect()
    assert all((x.quality_score > 0.5) == bool(x.doc_id % 2) and x.keep == bool(x.doc_id % 2) for x in scored)
    view = quality.train(docs, labels, rounds=0)[0]
    held = [(0, [(view.text, view.text_scale), (view.meta, view.meta_scale)])]
    named = quality.surest(docs, dict(held), {0: (5, 5)}, np.zeros(0, np.int64)).collect()
    assert Counter((x.view, x.high) for x in named) == {(v, h): 5 for v in (0, 1) for h in (0, 1)}
    of = {x.h: x.doc_id for x in docs.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    assert all(of[x.hash] % 2 == x.high for x in named)


# tokens


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cut_words_give_the_tokenizers_ids(name):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.tokenizer(name))
    whole.encode_special_tokens = True
    mine, r = tokens.Encoder(queries.tokenizer(name), 50), random.Random(7)
    assert mine.fast
    alphabet = list(" \n\t\0aAbéÉß.,!'’-0٣中🙂́ \x1f\x85()&sS") + ["</w>", "<|endoftext|>", " the", "\nNext"]
    for _ in range(8000):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 14)))
        assert np.frombuffer(mine.encode([text])[0], "<u4").tolist() == [*whole.encode(text, add_special_tokens=False).ids, 2], repr(text)
    assert len(mine.memo) <= 50 and len(mine.memo.old) <= 50


def test_token_files_skip_what_cannot_hold_a_document(spark, tmp_path):
    import pyarrow.orc as orc

    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    path = f"file://{tmp_path}/orc"
    orc_tokens.write_tokens(docs, path, queries.tokenizer("byte_bpe_50k.json"))
    some = [r.doc_id for r in docs.select("doc_id").orderBy("doc_id").limit(3).collect()]
    rows = orc_tokens.read_tokens(spark, path, some)
    assert sorted(r.doc_id for r in rows.collect()) == some
    assert "PushedFilters: [In(doc_id" in rows._jdf.queryExecution().toString()
    files = list((tmp_path / "orc").glob("*.orc"))
    meta = [orc.ORCFile(f) for f in files]
    assert sum(m.nrows for m in meta) == docs.count() and all(m.nstripes >= 1 for m in meta)
    bounds = sorted((m.read(["doc_id"]).column("doc_id")[0].as_py(), m.read(["doc_id"]).column("doc_id")[-1].as_py()) for m in meta if m.nrows)
    assert all(a[1] < b[0] for a, b in zip(bounds[:-1], bounds[1:], strict=True))


# words and near copies of very long texts


def test_word_hashes_do_not_depend_on_chunks(monkeypatch):
    texts = [b"one Two  three\n" * 50, b"", b"x" * 700, b" ", b"a b c"]
    wanted = words.word_hashes(texts)
    monkeypatch.setattr(words, "CHUNK_BYTES", 64)
    monkeypatch.setattr(words, "_powers", [])
    got = words.word_hashes(texts)
    assert (got[0] == wanted[0]).all() and (got[1] == wanted[1]).all()
    assert len(set(wanted[0].tolist())) == 7


def test_very_long_near_copies(spark):
    r = random.Random(1)
    base = [f"w{r.randint(0, 50_000)}" for _ in range(300_000)]
    near = list(base)
    for k in range(0, len(near), 60):  # about one shingle in twelve changes
        near[k] = "changed"
    far = list(base)
    for k in range(0, len(far), 20):
        far[k] = f"far{k}"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, "short text of its own")]
    found = {x.doc_id: x.component_id for x in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4}


def test_rows_of_one_id_with_other_texts_stay(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(7, a, "x"), (7, b, "y"), (8, a, "z"), (7, a, "x"), (9, None, "n"), (9, "", "m"), (None, a, "q")]
    kept = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, mark string")).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(7, a, "x"), (7, b, "y"), (9, None, "n"), (9, "", "m"), (None, a, "q")], key=repr)


def test_bands_of_a_leader_bound_what_can_link():
    """Sets in bands that aren't neighbours never link."""
    r = np.random.default_rng(4)
    leader = set(range(60))
    sets = [set(r.choice(90, r.integers(20, 80), replace=False).tolist()) for _ in range(120)] + [leader - set(range(k)) for k in range(20)]
    n, overlap = np.array([len(s) for s in sets]), np.array([len(s & leader) for s in sets])
    bands = near_copies.band(overlap, n, len(leader), 75)
    for i, a in enumerate(sets):
        assert (bands[i] == 0) == (100 * len(a & leader) >= 75 * len(a | leader))
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= 75 * len(a | b):
                assert abs(bands[i] - bands[j]) <= 1


@pytest.mark.parametrize("chunk, most", [(16, 8), (64, 1 << 20)])
def test_skipping_loses_no_links(spark, monkeypatch, chunk, most):
    """Lists cut into small chunks, and lists too large to hold, give the classes of brute force."""
    from tests.llm.test_queries import brute_classes

    monkeypatch.setattr(near_copies, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(near_copies, "LIST_ROWS", most)
    r, rows = random.Random(chunk), []
    for k in range(160):
        said = [f"b{k % 9}x{i}" for i in range(r.randint(3, 40))]
        for _ in range(k % 4):
            said[r.randrange(len(said))] = r.choice("uvw")
        rows.append((k, " ".join(said)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_copies.near_copies(df).collect())) == brute_classes(rows)


def test_components_of_a_path(spark):
    edges = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert components(edges).agg(F.min("component"), F.max("component"), F.count("*")).first() == (0, 0, 301)
