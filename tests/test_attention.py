"""Multi-head and typed attention against numpy, on a graph with a hub and a node that nothing reaches."""

import math

import numpy as np
import pytest

from kgspark.operators import attention

RNG = np.random.default_rng(12)
N, R, H, D = 24, 2, 2, 4
X = RNG.normal(size=(N, D))
TYPES = ["DRUG" if k % 3 else "DISEASE" for k in range(N)]
EDGES = sorted({(int(RNG.integers(N)), 0 if k < 60 else int(RNG.integers(1, N - 1)), int(RNG.integers(R))) for k in range(150)})  # 0 is a hub, N - 1 is reached by none
W = lambda *shape: RNG.normal(size=shape) / 2


@pytest.fixture(scope="module")
def graph(spark):
    features = spark.createDataFrame([(k, TYPES[k], X[k].tolist()) for k in range(N)], "node long, ntype string, vector array<double>")
    return spark.createDataFrame(EDGES, "src long, dst long, etype int"), features


def table(spark, tensors):
    return spark.createDataFrame([(str(r), b, k, row.tolist()) for (r, b), m in tensors.items() for k, row in enumerate(m)], "relation string, block int, row int, values array<double>")


def plain_table(spark, m):
    return spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(m)], "row int, values array<double>")


def softmax(s):
    e = np.exp(np.array(s) - max(s))
    return e / e.sum()


def linear(x, w):
    return np.append(x, 1) @ w


def compare(df, wanted):
    got = {r.node: r.vector for r in df.collect()}
    assert sorted(got) == list(range(N))
    assert all(np.allclose(got[k], wanted[k]) for k in range(N)), [k for k in range(N) if not np.allclose(got[k], wanted[k])]


@pytest.mark.parametrize(("how", "scaled", "concat"), [("dot", False, True), ("dot", True, False), ("additive", False, True)])
def test_multi_head(spark, graph, how, scaled, concat):
    left, right, root = W(D + 1, H * 3), W(D + 1, H * 3), W(D + 1, H * 3 if concat else 3)
    weights, att = W(R, D, H * 3), {(h, s): W(3) for h in range(H) for s in "lr"}
    out = np.array([linear(X[i], root) for i in range(N)])
    for i in range(N):
        total = np.zeros((H, 3))
        for r in range(R):
            sources = [s for s, d, e in EDGES if d == i and e == r]
            for h in range(H if sources else 0):
                cut = slice(h * 3, h * 3 + 3)
                q, ks = linear(X[i], right)[cut], [linear(X[s], left)[cut] for s in sources]
                if how == "dot":
                    scores = [q @ k / (math.sqrt(3) if scaled else 1) for k in ks]
                else:
                    scores = [q @ att[h, "l"] + k @ att[h, "r"] for k in ks]
                    scores = [s if s > 0 else 0.2 * s for s in scores]
                total[h] += sum(p * (X[s] @ weights[r])[cut] for p, s in zip(softmax(scores), sources))
        out[i] += total.ravel() if concat else total.mean(0)
    seen = spark.createDataFrame([(h, s, v.tolist()) for (h, s), v in att.items()], "head int, side string, values array<double>")
    found = attention.multi_head(*graph, plain_table(spark, left), plain_table(spark, right), table(spark, {(r, 0): weights[r] for r in range(R)}), H, how, scaled, seen, concat=concat, root=plain_table(spark, root))
    compare(found, out)


@pytest.mark.parametrize("norm", [False, True])
def test_typed_attention(spark, graph, norm):
    kinds, dk = ("DRUG", "DISEASE"), D // H
    k, q, v, a = ({t: W(D + 1, D) for t in kinds} for _ in range(4))
    att, msg, pri = W(R, H, dk, dk), W(R, H, dk, dk), RNG.uniform(0.5, 2, (R, H))
    skip = {"DRUG": 0.3, "DISEASE": -1.0}
    gain, shift = {t: W(D) + 1 for t in kinds}, {t: W(D) for t in kinds}
    out = np.zeros((N, D))
    for i in range(N):
        t, total = TYPES[i], np.zeros((H, dk))
        into = [(s, e) for s, d, e in EDGES if d == i]
        for h in range(H if into else 0):
            cut = slice(h * dk, h * dk + dk)
            scores = [linear(X[i], q[t])[cut] @ (linear(X[s], k[TYPES[s]])[cut] @ att[e, h]) * pri[e, h] / math.sqrt(dk) for s, e in into]
            total[h] = sum(p * (linear(X[s], v[TYPES[s]])[cut] @ msg[e, h]) for p, (s, e) in zip(softmax(scores), into))
        agg = np.array([0.5 * x * (1 + math.erf(x / math.sqrt(2))) for x in total.ravel()])
        gate = 1 / (1 + math.exp(-skip[t]))
        out[i] = linear(agg, a[t]) * gate + X[i] * (1 - gate)
        if norm:
            out[i] = (out[i] - out[i].mean()) / math.sqrt(out[i].var() + 1e-5) * gain[t] + shift[t]
    by_type = lambda m: table(spark, {(t, 0): m[t] for t in kinds})
    by_head = lambda m: table(spark, {(r, h): m[r, h] for r in range(R) for h in range(H)})
    priority = spark.createDataFrame([(r, h, float(pri[r, h])) for r in range(R) for h in range(H)], "relation int, head int, value double")
    norms = spark.createDataFrame([(t, gain[t].tolist(), shift[t].tolist()) for t in kinds], "ntype string, gain array<double>, shift array<double>") if norm else None
    found = attention.typed_attention(*graph, H, *map(by_type, (k, q, v, a)), by_head(att), by_head(msg), priority, spark.createDataFrame(list(skip.items()), "ntype string, value double"), norms)
    compare(found, out)


def test_large_scores_do_not_overflow_and_segments_may_be_null(spark):
    rows = spark.createDataFrame([(1, None, 900.0, [1.0]), (1, None, 900.0, [3.0]), (1, "a", -900.0, [5.0]), (2, "a", 0.0, [7.0])], "node long, part string, score double, vector array<double>")
    assert sorted(map(tuple, attention.attended(rows, ["node", "part"], ["node"]).collect())) == [(1, [7.0]), (2, [7.0])]
    assert attention.attended(rows.where("false"), ["node"], ["node"]).count() == 0
