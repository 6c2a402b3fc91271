"""Whitened vectors against numpy on all rows at once: tiles, nulls, repeats, unequal widths, huge values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.llm import whitening


def plain(rows, most=8):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max((len(v) for _, v in kept), default=0)
    x = [[int(min(max(math.floor(1024 * c), -(2**62)), 2**62 - 1024)) + 100_000 for c in [*v, *[0.0] * (dims - len(v))]] for _, v in kept]
    n, s = len(x), [sum(c) for c in zip(*x)]
    deviation = [min(sum((n * a - b) ** 2 for a, b in zip(r, s)), 2**63 - 1) for r in x]
    y = np.array([[(n * a - b) / n for a, b in zip(r, s)] for r in x])
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(most, int((e > e[0] * 1e-12).sum()))
    return [i for i, _ in kept], n, deviation, y @ (u[:, :k] / np.sqrt(e[:k])), e[:k] / np.trace(v)


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit("x")).withColumn("col", F.lit(1)).repartition(5)
    got = whitening.whiten(df, **options).collect()
    ids, n, deviation, white, share = plain(rows)
    k = len(share)
    assert len(got) == len(ids) * k and all(r.n == n for r in got)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-4
    by = lambda one: sorted(one, key=lambda r: (r[0] is None, r[0], r[1], tuple(np.round(np.abs(r[2]), 6))))
    vectors = {}
    for at, r in enumerate(got):
        vectors.setdefault(at // k, {})[r.component] = r
    mine = by((g[1].vec_id, g[1].deviation, np.array([g[c].whitened for c in range(1, k + 1)])) for g in vectors.values())
    want = by(zip(ids, deviation, white))
    assert [m[:2] for m in mine] == [w[:2] for w in want]
    a, b = np.array([m[2] for m in mine]), np.array([w[2] for w in want])
    sign = np.sign((a * b).sum(axis=0))
    assert np.abs(a * sign - b).max() < 1e-6
    for r in got:
        assert abs(r.explained / share[r.component - 1] - 1) < 1e-6


def made(seed, n, dims, spread=1.0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dims)) @ np.diag(np.linspace(3, 0.3, dims)) @ rng.normal(size=(dims, dims)) * spread
    return [(i, [float(c) for c in v]) for i, v in enumerate(base)]


@pytest.mark.parametrize("tile", [1, 5, 32])
def test_tiles(spark, tile):
    check(spark, made(1, 300, 12), tile=tile)


def test_nulls_repeats_and_unequal_widths(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 1000)
    rng = random.Random(2)
    rows = made(2, 200, 9)
    rows += [(rng.choice([i, None, 5]), v[: rng.randrange(10)]) for i, v in rows[:60]] + [(900, None), (901, [1.0, None]), (902, [math.nan]), (903, [math.inf] * 9), (904, []), (905, [-math.inf])]
    rows += [rows[3]] * 40
    check(spark, rows, tile=4)


def test_values_beyond_a_long(spark):
    check(spark, made(3, 100, 5, 1e14))
    rows = made(4, 60, 4) + [(k, [1e300, -1e300, 0.0, 1.0]) for k in range(100, 110)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in got} == {2**63 - 1} and got[0].identity_error < 1e-4


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [0.5, 0.25])], [(k, [0.5, 0.25]) for k in range(9)]])
def test_without_variance(spark, rows):
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_fewer_rows_than_dimensions(spark):
    check(spark, made(6, 5, 20))
