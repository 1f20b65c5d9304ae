"""The contract's queries against brute force: whole tables of sf0.001, and a table of edge cases."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.llm import fingerprints, languages, mixing, near_copies, orc_tokens, packing, private_data, quality, queries, secrets, topk
from tests.oracle import same

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(params=["documents", "edges"])
def docs(request):
    return request.getfixturevalue(request.param)


def known(i):
    return -1 if i is None else i


def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def ids_of(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer(name))
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text, add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


# secrets


def test_secrets_match_sql(spark):
    sf = "/root/testdata/sf0.01"
    same(queries.op2_secrets(spark, sf), queries.ORACLES["op2_secrets"], sf)


def brute_secrets(text):
    kinds = [
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
        ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
        ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 16),
    ]
    found = [(m.start(), k, kind, m.end()) for k, (kind, p, good) in enumerate(kinds) for m in re.finditer(p, text) if good(m)]
    line = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))
    return tuple(sum(f[1] == k for f in found) for k in range(3)) + (hashlib.sha256(line.encode()).hexdigest(),)


def test_secrets_match_brute_force(docs):
    mine = sorted(((known(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.digest(docs).collect()), key=str)
    assert mine == sorted(((known(i), *brute_secrets(t)) for i, t in texts(docs)), key=str)


def test_redaction_keeps_rows_and_columns(edges):
    out = secrets.redacted(edges)
    assert out.columns == edges.columns and out.count() == edges.count()
    assert not [r for r in out.collect() if "abcdefghijklmnop" in r.text or r.n_chars not in (None, len(r.text))]


# packing and token files


def test_packing_holds_every_id_once(docs):
    encode = ids_of("word_bpe_49k.json")
    pieces = packing.pack(docs, queries.tokenizer("word_bpe_49k.json")).collect()
    wanted = sorted((len(ids), crc(ids)) for ids in (encode(t) for _, t in texts(docs)))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append((p.offset, p.length))
    assert sum(p.length for p in pieces) == sum(n for n, _ in wanted)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    full = -(-sum(n for n, _ in wanted) // 4096)
    assert len(by_sequence) <= full * 1.1 + 8
    of = defaultdict(list)
    for i, t in texts(docs):
        of[i].append(encode(t))
    for i, lists in of.items():
        if len(lists) > 1:
            continue
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(lists[0]))
            assert p.ids_crc32 == crc(lists[0][at : at + p.length])
            at += p.length
        assert at == len(lists[0])


def test_token_files_round_trip(docs):
    encode = ids_of("byte_bpe_50k.json")
    mine = orc_tokens.tokens_round_trip(docs, queries.tokenizer("byte_bpe_50k.json")).collect()
    wanted = sorted((i if i is not None else -1, len(ids), crc(ids)) for i, ids in ((i, encode(t)) for i, t in texts(docs)))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_crc32) for r in mine) == wanted
    at = 0
    for r in sorted(mine, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    in_order = [r.doc_id if r.doc_id is not None else -1 for r in sorted(mine, key=lambda r: r.start)]
    assert in_order == sorted(in_order)


# exact top-k


def brute_top(rows, divisor, k):
    whole = {i: np.floor(256 * np.array(v, float)).astype(np.int64) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in whole:
        if q % divisor == 0:
            best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_top_k_matches_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in queries.table(spark, SF, "embeddings").collect()]
    assert sorted(map(tuple, queries.op4_top_k(spark, SF).select("query_id", "rank", "vec_id", "score").collect())) == brute_top(rows, 50, 5)


def test_top_k_with_ties_nulls_and_few_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 0.0]), (50, [-1.0, -0.001]), (100, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    found = topk.top_k(topk.quantised(df), F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, found)) == brute_top(rows, 50, 5)
    assert topk.top_k(topk.quantised(df.where("false")), F.col("vec_id") % 50 == 0).count() == 0


# mixing


def test_mixing_meets_targets(docs):
    rows = mixing.mixed(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")).collect()
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    sizes = defaultdict(int)
    for r in docs.select("source", "text").collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in order:
        assert abs(taken[s] - target[s]) <= max(2 * largest[s], 0.05 * target[s]), (s, taken[s], target[s])
    assert len(rows) == docs.count()


def test_mixing_repeats_itself(documents):
    a, b = (sorted(mixing.mixed(d).select("doc_id", "copies").collect()) for d in (documents, documents.repartition(5)))
    assert a == b


# languages


def test_languages_on_held_out_documents(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    rows = queries.op7_languages(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out and lang is not null").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_of_edges(edges, empty):
    rows = languages.languages(edges).collect()
    assert len(rows) == edges.count()
    assert {r.lang_pred for r in rows if r.doc_id in (1_000_001, 1_000_002, 1_000_003)} == {"und"}
    assert languages.languages(empty).count() == 0


# fingerprints


def test_fingerprints(docs):
    order = sorted(texts(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    wanted = []
    for k, (i, t) in enumerate(order):
        n = len(t) // 4
        changed = t[: len(t) - n] + order[(k + 1) % len(order)][1][:n]
        wanted.append((known(i), len(t), hashlib.sha256(changed.encode()).hexdigest()))
    rows = fingerprints.fingerprints(docs).collect()
    assert sorted((known(r.doc_id), r.n_chars, r.edited_sha256) for r in rows) == sorted(wanted)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert all(r.fingerprint == fingerprints.fingerprint(t).tobytes().hex() for r in rows for i, t in order if i == r.doc_id and sum(x[0] == i for x in order) == 1)
    long = [r for r in rows if r.n_chars > 500]
    assert not long or np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long])


def test_fingerprint_follows_the_definition():
    """Moved passages lower the likeness though the k-mers stay; equal texts agree."""
    a = " ".join(f"word{i}" for i in range(300))
    b = " ".join(f"word{i}" for i in [*range(150, 300), *range(150)])
    near = fingerprints.likeness(fingerprints.fingerprint(a), fingerprints.fingerprint(b))
    assert near < 0.9 and fingerprints.likeness(fingerprints.fingerprint(a), fingerprints.fingerprint(a)) == 1


# near copies


def brute_classes(rows):
    sets = []
    for _, t in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(t)]
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small and 100 * small >= 75 * large and 100 * (both := len(sets[a] & sets[b])) >= 75 * (small + large - both):
                root[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return sorted((known(i), len(sets[k]), least.get(top(k), -1)) for k, (i, _) in enumerate(rows))


def test_near_copies_match_brute_force(docs):
    assert sorted((known(r.doc_id), r.n_shingles, known(r.component_id)) for r in near_copies.near_copies(docs).collect()) == brute_classes(texts(docs))


def test_chains_and_large_groups(spark):
    """Near copies around the threshold, chained, and a group larger than two blocks."""
    rng, rows = np.random.default_rng(3), []
    base = [f"w{i}" for i in range(60)]
    for k in range(1200):
        words = list(base)
        for at in rng.integers(0, 60, k % 3):
            words[at] = f"x{rng.integers(0, 40)}"
        rows.append((k, " ".join(words)))
    chain = [f"c{i}" for i in range(200)]
    rows += [(5000 + k, " ".join(chain[5 * k : 5 * k + 60])) for k in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_copies.near_copies(df).collect())) == brute_classes(rows)


def test_one_of_each(edges, empty):
    kept = near_copies.one_of_each(edges)
    assert kept.columns == edges.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1_000_004 in ids and 1_000_006 not in ids and ids.count(1_000_009) == 1 and None in ids
    assert near_copies.near_copies(empty).count() == 0 and near_copies.one_of_each(empty).count() == 0


# personal data


def brute_private(text):
    digits = lambda s: re.findall("[0-9]", s)
    luhn = lambda d: sum(sum(divmod(int(x) * (1 + k % 2), 10)) for k, x in enumerate(reversed(d))) % 10 == 0
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    ]
    found = [[f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(p, text) if good(m[0])] for kind, p, good in kinds]
    return (*map(len, found), hashlib.sha256(",".join(sum(found, [])).encode()).hexdigest())


def test_private_data_matches_brute_force(docs):
    rows = private_data.digest(docs).collect()
    assert sorted((known(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows) == sorted((known(i), *brute_private(t)) for i, t in texts(docs))


def test_sanitised_texts_hold_no_base_value(edges):
    out = private_data.sanitised(edges)
    assert out.columns == edges.columns and out.count() == edges.count()
    assert not [r for r in out.collect() if r.text and sum(brute_private(r.text)[:4])]


def test_a_term_that_tells_its_entity_is_found(spark):
    rows = [(k, f"the chief of widgets {w} wrote from {m} on day {k}") for k, (w, m) in enumerate([("zarkon", "z@ex.org")] * 3 + [("many", "a@ex.org"), ("many", "b@ex.org")] * 2)]
    rows += [(100 + k, f"plain text number {k} about many widgets") for k in range(20)]
    spans = {r.doc_id: r.spans for r in private_data.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "term:21:27" in spans[0] and "term" not in spans[3] and spans[100] == ""


# quality


def test_quality_ranks_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op1_quality(spark, sf).join(queries.table(spark, sf, "labels"), "doc_id").collect()
    for score, label in (("quality_score", "quality"), ("toxic_score", "toxic")):
        good, bad = ([r[score] for r in rows if r[label] == v] for v in (1, 0))
        assert np.mean([np.mean([g > b for b in bad]) for g in good]) > 0.85


def test_quality_without_labels_and_on_edges(spark, edges, empty):
    labels = spark.createDataFrame([(1_000_004, 1, 0), (None, 0, 1), (1_000_009, None, None)], "doc_id long, quality int, toxic int")
    rows = quality.classify(edges, labels).collect()
    assert len(rows) == edges.count() and all(0 <= r.quality_score <= 1 for r in rows)
    assert quality.classify(empty, labels.where("false")).count() == 0


# empty tables


def test_empty_tables(empty):
    word, byte = map(queries.tokenizer, ("word_bpe_49k.json", "byte_bpe_50k.json"))
    for out in (secrets.digest(empty), packing.pack(empty, word), orc_tokens.tokens_round_trip(empty, byte), mixing.mixed(empty), fingerprints.fingerprints(empty), private_data.digest(empty)):
        assert out.count() == 0


# pipeline


def test_pipeline_packs_what_the_stages_keep(spark):
    import corpus_pipeline

    docs = queries.table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.columns
        docs = stage(spark, docs, SF)
        assert docs.columns == before, name
        docs = docs.cache()
    encode = ids_of("word_bpe_49k.json")
    packed = corpus_pipeline.pack(spark, docs, SF)
    assert packed.agg(F.sum("length")).first()[0] == sum(len(encode(t)) for _, t in texts(docs))


def test_stages_take_edge_cases(spark, edges, empty):
    """Each stage by itself on the table of edge cases: what its docstring says of them."""
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(known(r.doc_id) for r in df.select("doc_id").collect())
    every = ids(edges)
    kept = stage["language"](spark, edges, SF)
    assert kept.columns == edges.columns and not {1_000_001, 1_000_002, 1_000_003} & set(ids(kept)) and {1_000_009, 1_000_010} <= set(ids(kept))
    assert all(r.lang in ("en", "de", "fr") for r in kept.select("lang").collect())
    one = stage["near_duplicates"](spark, edges, SF)
    assert one.columns == edges.columns
    gone = sorted(set(every) - set(ids(one)))
    assert gone == [1_000_006] and ids(one).count(1_000_008) == 2 and ids(one).count(1_000_009) == 1 and {-1, 1_000_001, 1_000_002, 1_000_003} <= set(ids(one))
    clean = stage["secrets"](spark, edges, SF)
    assert clean.columns == edges.columns and ids(clean) == every
    of = {r.doc_id: r.text for r in clean.collect()}
    assert of[1_000_001] == "" and "[SECRET]" in of[1_000_007] and "deadbeefdeadbeef00" not in of[1_000_007] and of[1_000_010] == "long words of a very long text " * 20_000
    taken = stage["mix"](spark, edges, SF)
    assert taken.columns == edges.columns and not {1_000_001, 1_000_002, 1_000_003} & set(ids(taken)) and max(map(ids(taken).count, set(ids(taken)))) <= 4
    packed = stage["pack"](spark, edges, SF)
    encode = ids_of("word_bpe_49k.json")
    assert packed.agg(F.sum("length")).first()[0] == sum(len(encode(t)) for _, t in texts(edges))
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, empty, SF).count() == 0, name


def test_stages_act_on_all_that_was_kept(spark):
    """On a whole table each stage's own digest explains what it kept."""
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)
    docs = queries.table(spark, SF, "documents")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    lettered = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    kept = stage["language"](spark, docs, SF)
    assert set(ids(kept)) <= lettered and len(ids(kept)) >= 0.95 * len(lettered)
    least = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert ids(stage["near_duplicates"](spark, docs, SF)) == sorted(set(least.values()))
    clean = {r.doc_id: r.text for r in stage["secrets"](spark, docs, SF).collect()}
    for r in secrets.digest(docs).collect():
        assert ("[SECRET]" in clean[r.doc_id]) == (r.spans != "") and sum(brute_secrets(clean[r.doc_id])[:3]) == 0
    copies = {r.doc_id: r.copies for r in mixing.mixed(docs).collect()}
    taken = ids(stage["mix"](spark, docs, SF))
    assert {i: taken.count(i) for i in copies} == copies
