"""Draws with replacement: exact in number, even over rows, whatever the rate."""

import pytest
from pyspark.sql import functions as F

from kgspark.operators import draws, graph, splits


def counts(df, key="id"):
    return {r[0]: r[1] for r in df.groupBy(key).count().collect()}


@pytest.mark.parametrize(("n", "d"), [(1, 1), (1, 40_000), (3, 3000), (100, 10_000), (1000, 1), (20_000, 20), (5000, 5000), (7, 70_000), (100, 1_000_000)])
def test_as_many_as_asked(spark, n, d):
    out = draws.drawn(spark.range(n), "id", d)
    total, low, high, rows = out.groupBy("id").agg(F.count("*").alias("c"), F.min("draw").alias("a"), F.max("draw").alias("b")).agg(F.sum("c"), F.min("a"), F.sum("b"), F.count("*")).first()
    assert (total, low, high) == (d, 1, d) and rows <= n


def test_counts_are_multinomial(spark, monkeypatch):
    """Means, variances and covariances over rows of many draws, in small buckets and a deep tree."""
    monkeypatch.setattr(draws, "BUCKET_ROWS", 8)
    monkeypatch.setattr(draws, "BUCKET_DRAWS", 64)
    monkeypatch.setattr(draws, "FAN", 4)
    n, rate = 4000, 5
    got = counts(draws.drawn(spark.range(n), "id", n * rate))
    own = [got.get(k, 0) for k in range(n)]
    assert sum(own) == n * rate
    variance = sum((x - rate) ** 2 for x in own) / n
    assert 0.88 * rate < variance < 1.12 * rate  # Poisson-like: 1 +- 5 sigma
    none, wanted = own.count(0) / n, 0.0067
    assert abs(none - wanted) < 0.006
    halves = [sum(draws_ for k, draws_ in got.items() if k < n // 2) for got in [counts(draws.drawn(spark.range(n), "id", n * rate, seed)) for seed in range(6)]]
    assert len(set(halves)) > 3 and all(abs(h - n * rate / 2) < 5 * (n * rate / 4) ** 0.5 for h in halves)


def test_same_table_same_draws_and_other_seeds_others(spark):
    rows = spark.range(500)
    assert counts(draws.drawn(rows, "id", 700)) == counts(draws.drawn(rows, "id", 700)) != counts(draws.drawn(rows, "id", 700, 1))


def test_edges_of_a_draw(spark):
    rows = spark.createDataFrame([(None, "a"), (None, "a"), (1, "b"), (1, "b"), (1, "c")], "id int, draws string")
    assert draws.drawn(rows, "id", 90).count() == 90
    assert draws.drawn(rows.where("false"), "id", 90).count() == draws.drawn(rows, "id", 0).count() == 0
    assert draws.drawn(rows, "id", 90).columns == ["id", "draws", "draw"]


def test_groups_have_their_own_numbers(spark):
    rows = spark.range(6000).select("id", F.when(F.col("id") < 4000, "big").when(F.col("id") < 5990, "mid").when(F.col("id") < 5999, None).otherwise("one").alias("g"))
    assert counts(draws.drawn_by(rows, F.col("g"), "id", F.floor(F.col("n") * 0.3)), "g") == {"big": 1200, "mid": 597, None: 2}


def test_balanced_negatives_are_exact(spark):
    rows = spark.range(1100).select("id", (F.col("id") < 1000).cast("int").alias("y"))
    out = splits.balanced(rows, "y", "id", 10, replace=True)
    assert counts(out, "y") == {1: 1000, 0: 10_000}


def test_edges_divided_by_relation(spark):
    triples = spark.range(5000).select(F.col("id").alias("h"), (F.col("id") % 2).alias("r"), (F.col("id") + 1).alias("t"))
    out = graph.divide_edges(triples)
    got = {r[0]: r[1] for r in out.where("supervised").groupBy("r").count().collect()}
    assert out.count() == 5000 and all(abs(got[r] - 2500 * (1 - 2.718281828**-0.3)) < 70 for r in (0, 1))
