import random

import pytest
from pyspark.sql import functions as F

from kgspark.operators import graph
from tests.plans_rows import most_rows

SCHEMA = "id long, diseases array<string>, countries array<string>, start_year int, end_year int, phase int, drugs array<string>"


def brute(rows, phase, drug):
    out = set()
    for i, dis, loc, _, end, ph, dr in rows:
        for j, dis2, loc2, start, _, ph2, dr2 in rows:
            fits = i != j and end and start and end <= start and set(dis) & set(dis2) and set(loc) & set(loc2)
            if fits and (not phase or (ph is not None and ph2 is not None and ph + 1 == ph2)) and (not drug or sorted(dr) == sorted(dr2)):
                out.add((i, j))
    return out


@pytest.mark.parametrize("phase, drug", [(False, False), (True, False), (False, True), (True, True)])
def test_predecessors_match_brute_force(spark, phase, drug):
    r = random.Random(3)
    some = lambda letters: [r.choice(letters) for _ in range(r.randint(0, 3))]
    year = lambda: r.choice([None, 0, *range(2000, 2010)])
    rows = [(k, some("abc"), some("xyz"), year(), year(), r.choice([None, 1, 2, 3]), some("pq")) for k in range(80)]
    found = graph.predecessors(spark.createDataFrame(rows, SCHEMA), phase, drug).collect()
    assert len(found) == len(set(found)) and {tuple(f) for f in found} == brute(rows, phase, drug)


@pytest.mark.parametrize("phase, drug", [(False, False), (True, True)])
def test_what_many_share_is_dealt_in_parts(spark, phase, drug):
    r = random.Random(4)
    rows = [(k, r.sample("ab", r.randint(0, 2)), ["x"], r.randint(2000, 2005), r.randint(2000, 2005), r.choice([None, 1, 2]), ["p"]) for k in range(90)]
    found = graph.predecessors(spark.createDataFrame(rows, SCHEMA), phase, drug, most=5).collect()
    assert len(found) == len(set(found)) and {tuple(f) for f in found} == brute(rows, phase, drug)


def test_trials_are_neither_broadcast_nor_copied(spark):
    """Lists of diseases make far more rows than Spark's size of the table says."""
    ids = spark.range(2000).select("id", F.transform(F.sequence(F.col("id"), F.col("id") + 9), lambda x: x.cast("string")).alias("diseases"))
    trials = ids.select("id", "diseases", F.array(F.lit("x")).alias("countries"), (F.col("id") % 5 + 2000).cast("int").alias("start_year"), (F.col("id") % 5 + 2001).cast("int").alias("end_year"))
    found = graph.predecessors(trials)
    assert most_rows(found) < 200_000  # 320,000 where every trial is copied 16 times
    assert found.count() == sum(i != j and abs(i - j) <= 9 and i % 5 + 1 <= j % 5 for i in range(2000) for j in range(max(0, i - 9), min(2000, i + 10)))
    plan = found._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "ResolvedHint (strategy=merge)" in plan
