"""Components of any size are searched exactly."""

import random
from math import floor

import numpy as np

from tarnwork.llm import bitsliced


def test_large_components_are_ranked_exactly(spark):
    rng = random.Random(4)
    value = lambda: rng.choice([0.0, 0.5, -0.25, 1.0, 300000.0, -3e5, 1e15, 1e300, -1e300, 2.0**60])
    rows = [(i, [value() if rng.random() < 0.2 else rng.choice([0.0, 0.5, -1.0, 0.02]) for _ in range(4)]) for i in range(70)] + [(100 + i, [0.5, 0.25 * i, 1.0, 0.0]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ints = [(i, [floor(64 * x) if abs(x) < 2**40 else int(x) * 64 for x in v]) for i, v in rows]
    want = []
    for i, v in ints:
        if i % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ints if j != i)[:20]
            want += [(i, r + 1, j, max(min(-s, 2**63 - 1), -(2**63))) for r, (s, j) in enumerate(found)]
    assert sorted(tuple(r) for r in bitsliced.exact_top(df, rows=32, query_rows=2).collect()) == sorted(want)


def test_the_largest_row_comes_first(spark):
    df = spark.createDataFrame([(0, [1.0, 0.5]), (1, [300000.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id) for r in bitsliced.exact_top(df).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_slices_hold_their_vectors():
    x = np.random.default_rng(2).integers(-(2**20), 2**20, (131, 7))
    x[:, 3] = 5
    s = bitsliced.Slices.load(bitsliced.Slices(x).dump())
    assert (s.values() == x).all()
