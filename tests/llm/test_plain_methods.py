"""Packing's tree and mixing's rounding against their plain definitions, without Spark."""

import numpy as np
import pandas as pd

from kgspark.llm import mixing, packing


def plain_first_fit(lengths, capacity):
    rooms, where, offset = [], [0] * len(lengths), [0] * len(lengths)
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        k = next((k for k, room in enumerate(rooms) if room >= lengths[item]), None)
        if k is None:
            k = len(rooms)
            rooms.append(capacity)
        where[item], offset[item] = k, capacity - rooms[k]
        rooms[k] -= lengths[item]
    return where, offset


def test_tournament_tree_is_first_fit_decreasing():
    rng = np.random.default_rng(4)
    for n in [1, 2, 3, 7, 64, 65, 300]:
        for most in (3, 50, 100):
            lengths = rng.integers(1, most + 1, n)
            where, offset = packing.first_fit_decreasing(lengths, 100)
            assert (where.tolist(), offset.tolist()) == plain_first_fit(lengths.tolist(), 100)


def rounded(size, x, seed):
    u = np.random.default_rng(seed).uniform(size=len(x))
    return mixing._round(pd.DataFrame({"size": size, "x": x, "u": u}))["x"].to_numpy()


def test_pairs_keep_the_mass_and_leave_one_open():
    rng = np.random.default_rng(8)
    for n in (1, 2, 3, 10, 101):
        size, x = rng.integers(1, 60, n).astype(float), rng.uniform(0, 1, n)
        x[rng.uniform(size=n) < 0.2] = 1.0
        out = rounded(size, x, n)
        assert abs((size * out).sum() - (size * x).sum()) < 1e-6
        assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 1 and (out >= 0).all() and (out <= 1).all()


def test_pairs_are_unbiased():
    size, x = np.array([3.0, 5.0, 2.0, 7.0]), np.array([0.3, 0.6, 0.5, 0.25])
    mean = np.mean([rounded(size, x, seed) for seed in range(6000)], 0)
    assert np.abs(mean - x).max() < 0.03
