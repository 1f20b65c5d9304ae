import pytest
from pyspark.sql import functions as F

from kgspark.operators import graph
from tests.plans_rows import most_rows


def _chain(spark):
    """3,000 leaves under one term under one root, each leaf's key holding the term or the root too."""
    leaves = spark.range(3000).select(F.concat(F.lit("c"), "id").alias("child"), F.lit("n").alias("parent"))
    edges = leaves.unionAll(spark.createDataFrame([("n", "r")], "child string, parent string"))
    top = F.when(F.col("id") % 2 == 0, "n").otherwise("r")
    sets = spark.range(3000).select("id", F.explode(F.array(F.concat(F.lit("c"), "id"), top, F.lit("x"))).alias("v")).select(F.col("id").alias("key"), F.col("v").alias("id"))
    return sets, graph.closure(edges)


@pytest.mark.parametrize("keep", ["general", "specific"])
def test_no_term_meets_all_its_descendants(spark, keep):
    sets, ancestors = _chain(spark)
    found = graph.independent_ids(sets, ancestors, keep)
    assert most_rows(found) < 50_000  # 4.5 million where a key's term meets each of its leaves
    left = {(r.key, r.id) for r in found.collect()}
    top = lambda k: "r" if k % 2 else "n"
    assert left == {(k, "x") for k in range(3000)} | {(k, top(k) if keep == "general" else f"c{k}") for k in range(3000)}


@pytest.mark.parametrize("keep", ["general", "specific"])
def test_redundant_ids_match_brute_force(spark, keep):
    up = [("a", "b"), ("b", "c"), ("a", "c"), ("p", "q"), ("q", "p"), ("d", "c")]
    sets = [(1, "a"), (1, "c"), (1, "c"), (2, "b"), (2, "a"), (2, None), (3, "p"), (3, "q"), (4, "d"), (4, "b"), (None, "a"), (None, "b"), (5, "c")]
    below = lambda k, i, j: any(k2 == k and k is not None and i2 == j for k2, i2 in sets)
    gone = lambda k, i: any(below(k, i, (a if keep == "general" else n)) for n, a in up if i == (n if keep == "general" else a))
    want = sorted(((k, i) for k, i in sets if not gone(k, i)), key=repr)
    ancestors = spark.createDataFrame([(n, a, 1) for n, a in up], "node string, ancestor string, depth int")
    found = graph.independent_ids(spark.createDataFrame(sets, "key long, id string"), ancestors, keep)
    assert sorted(map(tuple, found.collect()), key=repr) == want
