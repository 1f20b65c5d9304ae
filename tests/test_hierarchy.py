"""Ancestors by tree numbers against the closure of the edges, level cuts and propagation on literal terms."""

import random

from pyspark.sql import functions as F

from kgspark.operators import graph, hierarchy

TERMS = [
    ("A", ["1"]), ("B", ["1.1", "2.5"]), ("C", ["1.1.1"]), ("D", ["1.1.1.1", "3.1.1"]), ("E", ["3.1"]), ("F", ["2"]), ("G", ["9.9.9.9"]), ("H", []), ("I", None), ("J", ["1.1.1.1.7.1"]), ("K", ["1.1.1.1.8"]), ("L", ["3"]),
]


def frame(spark, terms):
    return spark.createDataFrame([(*t, "clash") for t in terms], "id string, tree_numbers array<string>, number string")


def by_closure(spark, terms):
    flat = spark.createDataFrame([(i, n) for i, numbers in terms for n in numbers or []], "id string, tree_number string")
    return {(r.node, r.ancestor) for r in graph.closure(graph.tree_parents(flat)).collect() if r.node != r.ancestor}


def test_ancestors_are_those_of_the_closure(spark):
    mine = {tuple(r) for r in hierarchy.ancestors(frame(spark, TERMS)).collect()}
    # D is below C and E; F is above C by B's other number; J and G have gaps above them.
    assert mine == by_closure(spark, TERMS) and {("C", "F"), ("D", "L"), ("D", "F"), ("K", "D")} <= mine
    assert not [p for p in mine if p[0] in "GHIJ"]
    assert hierarchy.ancestors(frame(spark, TERMS).where("false")).count() == 0


def test_random_hierarchies(spark):
    rng = random.Random(6)
    numbers = [""]
    for _ in range(60):
        numbers.append((rng.choice(numbers) + f".{rng.randint(0, 9)}").lstrip("."))
    terms = {}
    for n in set(numbers[1:]):
        terms.setdefault(f"t{rng.randint(0, 45)}", []).append(n)
    terms = list(terms.items())
    assert {tuple(r) for r in hierarchy.ancestors(frame(spark, terms)).collect()} == by_closure(spark, terms)


def test_cut_and_population(spark):
    terms = frame(spark, TERMS)
    above = hierarchy.ancestors(terms)
    sets = spark.createDataFrame([("x", "D"), ("x", "A"), ("x", "HEALTHY"), ("y", "K"), ("z", "H"), ("w", "G")], "key string, id string")
    assert sorted(map(tuple, hierarchy.cut(sets, terms, above, 2).collect())) == [("x", "A"), ("x", "B"), ("x", "E"), ("x", "HEALTHY"), ("y", "B"), ("y", "E")]
    trials = spark.createDataFrame([("t1", ["Dee ", "nothing", None]), ("t2", ["healthy volunteers", "aye"]), ("t3", []), ("t4", None)], "trial string, terms array<string>")
    names = spark.createDataFrame([("dee", "D"), ("Aye", "A")], "name string, id string")
    values = spark.createDataFrame([("D", "v1"), ("C", "v2"), (None, "v3")], "id string, value string")
    plain = {r.trial: r for r in hierarchy.population(trials, names, values, terms, 2).collect()}
    assert (plain["t1"].ids, plain["t1"].associated_ids, plain["t1"].associations, plain["t1"].cut_ids, plain["t1"].cut_associated_ids, plain["t1"].healthy) == (["D"], ["D"], ["v1"], ["B", "E"], ["B", "E"], False)
    assert (plain["t2"].ids, plain["t2"].associated_ids, plain["t2"].cut_ids, plain["t2"].healthy) == (["A"], [], ["A"], True)
    assert plain["t3"].ids == plain["t4"].cut_ids == [] and len(plain) == 4
    up = {r.trial: r for r in hierarchy.population(trials, names, values, terms, 2, propagate=True).collect()}
    assert up["t2"].associated_ids == ["A"] and up["t2"].associations == ["v1", "v2"] and up["t1"].associations == ["v1"]


def test_prefixes(spark):
    assert spark.createDataFrame([("1.22.3",), ("4",)], "n string").select(hierarchy.prefixes(F.col("n"))).collect()[0][0] == ["1", "1.22"]
