import random

from kgspark.operators import splits


def test_components_of_rows_match_a_walk(spark):
    """Split by components in the order of their least names, as a walk over the rows finds them; nulls link nothing."""
    r = random.Random(12)
    rows = [(r.choice([None, *range(60)]), r.choice([None, *range(45)])) for _ in range(90)] + [(70, 5), (71, 5), (72, 5), (73, 5), (5, 5), (100, None), (99, 77), (99, 77)]
    rest = {a for a, b in rows if a is not None and b is not None}
    sizes = {}
    while rest:
        part, todo = set(), [min(rest)]
        while todo:
            a = todo.pop()
            if a not in part:
                part.add(a)
                rights = {b for x, b in rows if x == a and b is not None}
                todo += [x for x, b in rows if x is not None and b in rights]
        rest -= part
        sizes[min(f"l:{a}" for a in part)] = part
    n = {c: sum(x in p for x, _ in rows) for c, p in sizes.items()}
    total, before, train, want = sum(n.values()), 0, 0, {}
    for c in sorted(n):
        if before < int(total * 0.7):
            split, train = "train", train + n[c]
        else:
            split = "val" if before - train < int(total * 0.15) else "test"
        before += n[c]
        want |= {a: split for a in sizes[c]}
    found = splits.component_split(spark.createDataFrame(rows, "a long, b long"), "a", "b", order=["component"])
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(((a, b, want[a]) for a, b in rows if a in want), key=repr)


def test_only_shared_values_become_edges(spark, monkeypatch):
    """2,000 rows, of which two share their right value: one edge, not one a row."""
    met = []

    def counted(edges, *ends):
        met.append(edges.count())
        return real(edges, *ends)

    real = splits.components
    monkeypatch.setattr(splits, "components", counted)
    rows = spark.createDataFrame([(k, k) for k in range(1999)] + [(1999, 7)], "a long, b long")
    assert splits.component_split(rows, "a", "b").count() == 2000
    assert met == [1]


def test_violations_are_counted(spark):
    rows = spark.createDataFrame([(1, "train"), (1, "val"), (2, "val"), (2, "val"), (3, None), (3, "test"), (4, None)], "k long, split string")
    assert {x.check: x.n for x in splits.violations(rows, "k").collect()} == {"null split": 2, "straddling key": 1}
