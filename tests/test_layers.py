"""Relational layers against numpy, by dense tensors; fitted heads against a plain Newton fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.operators import heads, layers

RNG = np.random.default_rng(3)
N, R, IN, OUT = 40, 3, 8, 6
X = RNG.normal(size=(N, IN))
EDGES = [(int(RNG.integers(N)), 0 if k < 120 else int(RNG.integers(N)), int(RNG.integers(R)), float(RNG.uniform(0.5, 2))) for k in range(400)]  # node 0 is a hub
ROOT, BIAS = RNG.normal(size=(IN, OUT)), RNG.normal(size=OUT)


@pytest.fixture(scope="module")
def features(spark):
    return spark.createDataFrame([(k, X[k].tolist()) for k in range(N)], "node long, vector array<double>")


def edges(spark, weighed):
    df = spark.createDataFrame(EDGES, "src long, dst long, etype int, weight double")
    return df if weighed else df.drop("weight")


def rows_of(spark, tensors):
    """(relation, block, row, values) of {(relation, block): matrix}."""
    return spark.createDataFrame([(str(r), b, k, row.tolist()) for (r, b), m in tensors.items() for k, row in enumerate(m)], "relation string, block int, row int, values array<double>")


def plain(full, how, weighed, root=True):
    out = np.zeros((N, OUT)) + (X @ ROOT + BIAS if root else 0)
    for r in range(R):
        for i in range(N):
            sent = [X[s] * (w if weighed else 1) for s, d, e, w in EDGES if d == i and e == r]
            if sent:
                out[i] += (np.mean(sent, 0) if how == "avg" else np.sum(sent, 0)) @ full[r]
    return out


def tables(spark):
    root = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(ROOT)], "row int, values array<double>")
    bias = spark.createDataFrame([(k, float(b)) for k, b in enumerate(BIAS)], "place int, value double")
    return root, bias


def compare(df, wanted):
    got = {r.node: r.vector for r in df.collect()}
    assert sorted(got) == list(range(N))
    assert all(np.allclose(got[k], wanted[k]) for k in range(N))


@pytest.mark.parametrize(("how", "weighed"), [("avg", False), ("sum", True), ("avg", True)])
def test_full_weights(spark, features, how, weighed):
    full = RNG.normal(size=(R, IN, OUT))
    out = layers.relational_layer(edges(spark, weighed), features, rows_of(spark, {(r, 0): full[r] for r in range(R)}), *tables(spark), how=how)
    compare(out, plain(full, how, weighed))


def test_basis_form(spark, features):
    basis, comp = RNG.normal(size=(2, IN, OUT)), RNG.normal(size=(R, 2))
    table = spark.createDataFrame([(r, b, float(comp[r, b])) for r in range(R) for b in range(2)], "relation int, basis int, c double")
    out = layers.relational_layer(edges(spark, False), features, rows_of(spark, {(b, 0): basis[b] for b in range(2)}), *tables(spark), comp=table)
    compare(out, plain(np.einsum("rb,bio->rio", comp, basis), "avg", False))


def test_block_diagonal_form(spark, features):
    blocks = RNG.normal(size=(R, 2, IN // 2, OUT // 2))
    full = np.zeros((R, IN, OUT))
    for r in range(R):
        for b in range(2):
            full[r, b * 4 : b * 4 + 4, b * 3 : b * 3 + 3] = blocks[r, b]
    out = layers.relational_layer(edges(spark, False), features, rows_of(spark, {(r, b): blocks[r, b] for r in range(R) for b in range(2)}), *tables(spark), blocks=2)
    compare(out, plain(full, "avg", False))


def test_without_root_relations_and_edges(spark, features):
    full = RNG.normal(size=(R, IN, OUT))
    weights = rows_of(spark, {(0, 0): full[0]})
    out = {r.node: r.vector for r in layers.relational_layer(edges(spark, False), features, weights).collect()}
    full[1:] = 0
    wanted = plain(full, "avg", False, root=False)
    assert all(np.allclose(out[k], wanted[k]) if out[k] else not wanted[k].any() for k in range(N))
    none = layers.relational_layer(edges(spark, False).where("false"), features, weights, *tables(spark))
    compare(none, X @ ROOT + BIAS)
    assert layers.relational_layer(edges(spark, False), features.where("false"), weights, *tables(spark)).count() == 0


def test_wide_layers_are_small_plans(spark):
    """Width 800 x 800: the weights stay rows of a table."""
    weights = layers.seeded_weights(spark, {"0": (800, 800)})
    features = spark.range(20).select(F.col("id").alias("node"), F.array_repeat(F.lit(0.01), 800).alias("vector"))
    edges_ = spark.range(20).select(F.col("id").alias("src"), ((F.col("id") + 1) % 20).alias("dst"), F.lit(0).alias("etype"))
    out = layers.relational_layer(edges_, features, weights)
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 30_000
    got = {r.node: r.vector for r in out.collect()}
    matrix = np.array([r["values"] for r in weights.orderBy("row").collect()])
    assert matrix.shape == (800, 800) and np.abs(matrix).max() <= (6 / 1600) ** 0.5
    assert np.allclose(got[3], 0.01 * matrix.sum(0))


def test_mixed_embedding_and_dense(spark):
    weights = layers.seeded_weights(spark, {"DRUG": (2, 3)}, 5)
    nodes = spark.createDataFrame([(1, "DRUG", [1.0, 2.0]), (2, "DRUG", None), (3, "ELSE", [1.0]), (4, "DRUG", [1.0])], "node long, etype string, vector array<double>")
    matrix = np.array([r["values"] for r in weights.orderBy("row").collect()])
    a, b = ({r.node: r.vector for r in layers.mixed_embedding(nodes, weights, 3, 5).collect()} for _ in range(2))
    assert a == b and np.allclose(a[1], np.array([1, 2]) @ matrix) and np.allclose(a[4], matrix[0])
    assert len(a[2]) == 3 and a[2] != a[3] and all(-1 <= x <= 1 for x in a[2])
    rows = spark.createDataFrame([(0, [1.0, 1.0]), (1, [2.0, 0.0])], "row int, values array<double>")
    bias = spark.createDataFrame([(0, 0.0), (1, 0.5)], "place int, value double")
    one = spark.createDataFrame([(7, [1.0, -1.0])], "node long, vector array<double>")
    assert layers.dense(one, rows, bias).first().vector == [0.0, 1.5] and layers.dense(one, rows, bias, relu=False).first().vector == [-1.0, 1.5]


# Fitted heads


def plain_fit(x, y, weight, l2, positive):
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    c, held, w = weight * np.where(y > 0, positive, 1.0), np.full(x.shape[1], l2), np.zeros(x.shape[1])
    held[-1] = 0
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + np.diag(held), x.T @ (c * (p - y)) + held * w)
    return w


def sample(n=600, d=5):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(n, d))
    true = rng.normal(size=(3, d + 1))
    chance = 1 / (1 + np.exp(-(np.concatenate([x, np.ones((n, 1))], 1) @ true.T - [0, 0, 2])))
    y = (rng.uniform(size=chance.shape) < chance).astype(float)
    y[rng.uniform(size=y.shape) < 0.2] = np.nan
    return x, y, rng.uniform(0.5, 2, n)


@pytest.mark.parametrize("balanced", [True, False])
def test_fit_equals_a_plain_fit_and_serves_rows_held_out(spark, balanced):
    x, y, weight = sample()
    train = [(x[k].tolist(), [None if np.isnan(v) else float(v) for v in y[k]], float(weight[k]), "clash") for k in range(400)]
    rows = spark.createDataFrame(train + [(None, [1.0, 1.0, 1.0], 1.0, "")], "vector array<double>, ys array<double>, weight double, label string").repartition(4)
    model = heads.fit(rows, 3, 5, 0.7, balanced)
    for k in range(3):
        known = ~np.isnan(y[:400, k])
        own_y, own_w = y[:400, k][known], weight[:400][known]
        positive = ((own_w * (1 - own_y)).sum() / (own_w * own_y).sum()) ** 0.5 if balanced else 1.0
        assert np.abs(model[k] - plain_fit(x[:400][known], own_y, own_w, 0.7, positive)).max() < 1e-4
    test = spark.createDataFrame([(k, x[k].tolist()) for k in range(400, 600)], "key long, vector array<double>")
    p = {(r.key, r.label): r.p for r in heads.scored(test, model, "key").collect()}
    assert len(p) == 600
    for k in range(3):
        pos = [p[i, k] for i in range(400, 600) if y[i, k] == 1]
        neg = [p[i, k] for i in range(400, 600) if y[i, k] == 0]
        assert np.mean([a > b for a in pos for b in neg]) > 0.7


def test_labels_without_rows_and_empty_tables(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, None]), ([0.0, 1.0], [0.0, None]), ([1.0, 1.0], None)], "vector array<double>, ys array<double>")
    model = heads.fit(rows, 2, 2)
    assert not model[1].any() and model[0][0] > 0 > model[0][1]
    assert not heads.fit(rows.where("false"), 2, 2).any()


def test_pair_head(spark, features):
    pairs = spark.createDataFrame([(a, b, float(X[a, 0] > X[b, 0])) for a in range(N) for b in range(0, N, 7) if a != b] + [(0, 999, 1.0)], "arm1 long, arm2 long, y double")
    rows = heads.pair_rows(pairs, features)
    assert rows.count() == pairs.count() - 1
    model = heads.fit(rows.withColumn("ys", F.array("y")), 1, 2 * IN, 0.1)[0]
    assert model[0] > 1 and model[IN] < -1 and abs(model[1]) < abs(model[0]) / 2
