"""Vector codes, the Merkle manifest and byte-level BPE against plain definitions: whole tables of sf0.001, and edge cases."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.llm import byte_pairs, merkle, queries, vector_codes
from tests.oracle import same

SF = "/root/testdata/sf0.01"


@pytest.fixture(params=["documents", "edges", "empty"])
def docs(request):
    return request.getfixturevalue(request.param)


# vector codes

VECTORS = [
    (None, [0.5, -0.25, 0.125, 1.0] * 4, 1),
    (3, [0.1 * k for k in range(16)], 1),
    (3, [0.1 * k for k in range(16)], 1),
    (4, [0.1, -0.2], None),
    (5, None, 1),
    (6, [0.1, None], 1),
    (7, [float("nan"), 1.0], 2),
    (8, [float("-inf")] * 16, 2),
    (9, [], 2),
    (10, [9e9, -9e9] + [0.0] * 14, 2),
    *[(20 + k, [((k * 7 + j * 3) % 11) / 10 - 0.5 for j in range(16)], k % 3 or None) for k in range(60)],
    *[(100, [0.25] * 16, 7)] * 40,
]


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """Lloyd's rounds as the contract words them."""
    most = vector_codes.MOST
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept = [(i, [max(-most, min(most, int(np.floor(np.float64(np.float32(x)) * 4096)))) for x in v], label) for i, v, label in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    cut = [np.array([*v, *[0] * (width * parts - len(v))], object).reshape(parts, width) for _, v, _ in kept]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            mine = [near(p, v[p])[1] for v in cut]
            new = []
            for k, e in enumerate(books[p]):
                own = [v[p] for v, m in zip(cut, mine) if m == k]
                new.append([sum(x) // len(own) for x in zip(*own)] if own else e)
            books[p] = new
    found = [[near(p, v[p]) for p in range(parts)] for v in cut]
    sums = Counter()
    for (_, _, label), f in zip(kept, found):
        sums[label] += sum(d for d, _ in f)
    named = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), sums[label], named) for (i, _, label), f in zip(kept, found)]


@pytest.mark.parametrize("rows", [VECTORS, VECTORS[:4], VECTORS[4:8], [(k, [float(k)] * 16, 0) for k in range(20)]])
def test_vector_codes_match_plain_rounds(spark, rows, monkeypatch):
    monkeypatch.setattr(vector_codes, "LEAF", 3)
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, code string, v string").repartition(3)
    mine = [tuple(r) for r in vector_codes.digest(frame).collect()]
    assert sorted(mine, key=str) == sorted(plain_codes(rows) if any(r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1]) for r in rows) else [], key=str)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_vector_codes_match_sql(spark, sf):
    same(queries.op11_vector_codes(spark, f"/root/testdata/{sf}"), queries.ORACLES["op11_vector_codes"], f"/root/testdata/{sf}")


def test_filtering_assigns_what_all_comparisons_do():
    rng = np.random.default_rng(5)
    for n, k, w, spread in ((1, 1, 2, 5), (40, 3, 1, 2), (1000, 16, 2, 50), (3000, 16, 3, 4), (500, 9, 8, 1000)):
        points, entries = rng.integers(-spread, spread, (n, w)), rng.integers(-spread, spread, (k, w))
        tree = vector_codes.Tree.build(points)
        sums, counts, who = tree.assign(entries, owned=True)
        plain = ((points[:, None] - entries[None]) ** 2).sum(2).argmin(1)
        assert (who == plain[tree.order]).all()
        assert (counts == np.bincount(plain, minlength=k)).all()
        assert all((sums[e] == points[plain == e].sum(0)).all() for e in range(k))


def test_filtering_assigns_far_subtrees_at_once():
    points = np.concatenate([np.random.default_rng(1).integers(0, 50, (2000, 4)) + c for c in (0, 10_000, 20_000)])
    tree = vector_codes.Tree.build(points)
    entries = np.array([[25] * 4, [10_025] * 4, [20_025] * 4])
    asked = []
    keep = vector_codes.filtered
    vector_codes.filtered = lambda e, low, high, o: asked.append(len(low)) or keep(e, low, high, o)
    try:
        _, counts, _ = tree.assign(entries)
    finally:
        vector_codes.filtered = keep
    assert counts.tolist() == [2000] * 3 and sum(asked) < 60


def test_codes_decode_to_their_entries(spark):
    rows = vector_codes.quantised(spark.createDataFrame(VECTORS[:4], "vec_id long, embedding array<float>, label int"))
    trees, books = vector_codes.fit(rows)
    out = vector_codes.decoded(vector_codes.coded(trees, books), books).collect()
    assert len(out) == 4
    for r in out:
        wanted = [x / 4096 for p in range(8) for x in books[p, int(r.code[2 * p : 2 * p + 2], 16)]]
        assert r.approx == pytest.approx(wanted)


# Merkle manifest


def plain_manifest(rows):
    H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: H(*map(field, (r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + more, r.text)))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
        return levels

    def path(levels, at):
        out = []
        for level in levels[:-1]:
            run = level[at // 2 * 2 : at // 2 * 2 + 2]
            out.append((at % 2, [d for k, d in enumerate(run) if k != at % 2]))
            at //= 2
        return out

    by = {}
    for r in rows:
        by.setdefault(r.lang, []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        by[lang].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
    trees = {lang: tree([leaf(r) for r in by[lang]]) for lang in langs}
    top = tree([trees[lang][-1][0] for lang in langs]) if langs else None
    out = []
    for k, lang in enumerate(langs):
        for at, r in enumerate(by[lang]):
            steps = path(trees[lang], at) + path(top, k)
            tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            acc = leaf(r, int(tampered))
            for right, siblings in steps:
                acc = H(*siblings, acc) if right else H(acc, *siblings)
            root = top[-1][0]
            out.append((r.doc_id, leaf(r), trees[lang][-1][0], root, H(*[d for _, s in steps for d in s]), acc, acc == root))
    return out


def test_manifest_matches_plain_trees(docs, monkeypatch):
    for block in (4, 1024):
        monkeypatch.setattr(merkle, "BLOCK", block)
        mine = [tuple(r) for r in merkle.manifest(docs).collect()]
        assert sorted(mine, key=str) == sorted(plain_manifest(docs.collect()), key=str)


def test_manifest_matches_sql(spark):
    same(queries.op12_merkle(spark, SF), queries.ORACLES["op12_merkle"], SF)


def test_manifest_of_one_row_and_of_groups_of_one(spark):
    rows = [(k, "t", f"l{k}" if k else None, "s", k) for k in range(9)]
    for n in (1, 2, 9):
        frame = spark.createDataFrame(rows[:n], "doc_id long, text string, lang string, source string, n_chars long")
        assert sorted(map(tuple, merkle.manifest(frame).collect()), key=str) == sorted(plain_manifest(frame.collect()), key=str)


def test_traversal_of_every_length():
    for n in range(1, 40):
        leaves = [bytes([k]) * 32 for k in range(n)]
        root, paths = merkle.traverse(leaves, (n - 1).bit_length())
        assert all(merkle.folded(d, p.tobytes()) == root for d, p in zip(leaves, paths))
        assert n == 1 or merkle.folded(b"\xff" * 32, paths[0].tobytes()) != root


# byte-level BPE


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import base64

    import public_tokenizers
    import tiktoken

    with open(queries.tokenizer("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def asked():
    import public_tokenizers

    return queries.tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def test_ids_and_texts_match_the_library(docs, tiktoken_encoding, asked):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    mine = [tuple(r) for r in byte_pairs.digest(docs, *asked).collect()]
    wanted = []
    for r in docs.select("doc_id", "text").collect():
        ids = tiktoken_encoding.encode_ordinary(r.text or "")
        wanted.append((r.doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha((r.text or "").encode())))
    assert sorted(mine, key=str) == sorted(wanted, key=str)


def test_encode_and_decode_round_trip(docs, tiktoken_encoding, asked):
    rows = byte_pairs.encode(docs, *asked)
    texts = sorted((r.text or "").encode() for r in docs.select("text").collect())
    assert sorted(bytes(r.bytes) for r in byte_pairs.decode(rows, *asked).collect()) == texts
    assert sorted(map(tuple, rows.select("ids").collect()), key=str) == sorted(((tiktoken_encoding.encode_ordinary(t.decode()),) for t in texts), key=str)


def test_odd_words_match_the_library(tiktoken_encoding, asked):
    random.seed(7)
    pick = lambda letters, n: "".join(random.choice(letters) for _ in range(n))
    odd = ["", " ", "  ", "a  b", " a", "a ", "a\n b", "\n\n x\n", "x　y   z", "a\x1cb \x1c c\x85 d", "can't we'll  I'M", "a" * 3000, " " * 500 + "x", "ab" * 700]
    odd += [pick("abcdefgh zqxé\n '1!", 400) for _ in range(60)] + [pick("abcdefghijklmnopqrstuvwxyz", n) for n in (63, 64, 65, 300, 2000)] + [pick("\U0001f600中Ж́", 300)]
    codec = byte_pairs.Codec(*asked)
    for _ in range(2):  # the second time from the memo
        said = codec.encode(odd)
        assert said == [" ".join(map(str, tiktoken_encoding.encode_ordinary(t))) for t in odd]
    assert codec.decode([np.fromstring(s, np.int32, sep=" ") for s in said]) == [t.encode() for t in odd]


def test_memo_generations_and_query_bounds(tiktoken_encoding, asked, monkeypatch):
    monkeypatch.setattr(byte_pairs, "MEMO_WORDS", 20)
    monkeypatch.setattr(byte_pairs, "QUERY_WORDS", 3)
    monkeypatch.setattr(byte_pairs, "QUERY_IDS", 5)
    codec = byte_pairs.Codec(*asked)
    texts = [" ".join(f"word{k % 17}x{k}" for k in range(a, a + 30)) for a in range(0, 200, 7)]
    for t in texts + texts:
        assert codec.encode([t]) == [" ".join(map(str, tiktoken_encoding.encode_ordinary(t)))]
        assert len(codec.behind) <= 60
        assert codec.decode([np.array(tiktoken_encoding.encode_ordinary(t))]) == [t.encode()]


def test_other_columns_keep_their_names(edges, asked):
    out = byte_pairs.encode(edges.withColumn("ids", F.lit("clash")), *asked)
    assert out.columns == ["doc_id", "ids"] and out.count() == edges.count()
