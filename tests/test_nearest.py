import random
from decimal import ROUND_HALF_UP, Decimal

import pytest

from kgspark.operators import scoring

SCHEMA = "id long, vector array<float>"


def plain(queries, rows, k, digits):
    """Cosines summed in order of place and rounded half up; rows without a score last, NaN above all."""
    import numpy as np

    def unit(v):
        if v is None or None in v:
            return None
        v = [float(np.float32(x)) for x in v]
        n = 0.0
        for x in v:
            n += x * x
        n = float(np.sqrt(n))
        return [x / (n if n != n or n > 1e-12 else 1e-12) for x in v]

    out = []
    for q, a in queries:
        scores = []
        for i, b in rows:
            if q is None or i is None or q == i:
                continue
            x, y = unit(a), unit(b)
            s = None
            if x is not None and y is not None and len(x) == len(y):
                s = 0.0
                for c, d in zip(x, y, strict=True):
                    s += c * d
                s = s if s != s else float(Decimal(repr(s)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
            scores.append((s is None, 0 if s is None else -float("inf") if s != s else -s, i, s))
        out += [(q, n + 1, x[2], repr(x[3])) for n, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out)


@pytest.mark.parametrize("block, tile, digits", [(2**22, 2**21, 4), (40, 30, 4), (64, 1, 1)])
def test_nearest_matches_plain_cosines(spark, monkeypatch, block, tile, digits):
    monkeypatch.setattr(scoring, "BLOCK", block)
    monkeypatch.setattr(scoring, "TILE", tile)
    r = random.Random(6)
    rows = [(k, [r.choice([0.0, 1.0, -1.0, 0.5, r.random()]) for _ in range(4)]) for k in range(60)]
    rows += [(k, [1.0, 2.0, 3.0, 4.0]) for k in range(60, 75)]  # copies
    rows += [(75, None), (76, [1.0, None, 1.0, 1.0]), (77, [0.0] * 4), (78, [float("nan"), 1.0, 1.0, 1.0]), (79, [1.0, 2.0]), (None, [1.0] * 4), (80, []), (81, [float("inf"), 1.0, 1.0, 1.0])]
    queries = [x for x in rows if x[0] is None or x[0] % 5 in (0, 4)]
    make = lambda x: spark.createDataFrame(x, SCHEMA)
    found = scoring.nearest(make(queries), make(rows), 3, digits=digits).collect()
    assert sorted((*x[:3], repr(x[3])) for x in found) == plain(queries, rows, 3, digits)


def test_products_are_rounded_half_up_in_order_of_place():
    import numpy as np

    a = np.array([[0.1, 0.1], [0.3, 0.4], [1.0, 0.0], [-1.0, 0.0]])
    b = np.array([[0.25, 0.25], [0.5, 0.25], [0.125, 0.0], [0.125, 0.0]])
    assert scoring.half_up(scoring._products(a, b), 2).tolist() == [0.05, 0.25, 0.13, -0.13]


def test_products_are_made_by_blocks(spark):
    """No plan joins each query with each row."""
    rows = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(50)], SCHEMA)
    plan = scoring.nearest(rows.where("id % 10 = 0"), rows, 3)._jdf.queryExecution().toString()
    assert "Join" not in plan and "CoGroup" in plan
