"""Recall of the posting lists where vectors differ in length: over a hundred lists, against all inner products."""

import numpy as np
import pytest

from tarnwork.llm import postings


def made(kind, n, dims=32, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    if "clustered" in kind:
        c = rng.normal(size=(n // 100, dims))
        x = c[rng.integers(len(c), size=n)] + 0.4 * x
    x /= np.linalg.norm(x, axis=1)[:, None]
    if "lognormal" in kind:
        x *= np.exp(0.7 * rng.normal(size=n))[:, None]
    if "spread" in kind:
        x *= rng.uniform(0.5, 2, size=n)[:, None]
    if "tiny" in kind:
        x[:40] *= 1e-200
    return x


def recall(spark, x, **options):
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    found = {}
    for r in postings.nearest_vectors(df, **options).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    q = np.arange(0, len(x), 20)
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -np.inf
    best = np.argsort(-s, axis=1)[:, :20]
    assert sorted(found) == q.tolist() and all(len(v) == 20 for v in found.values())
    share = [len(set(found[i]) & set(b.tolist())) / 20 for i, b in zip(q.tolist(), best)]
    return np.mean(share), min(share)


@pytest.mark.parametrize("kind", ["unit", "clustered", "lognormal", "clustered lognormal", "spread", "tiny clustered lognormal"])
def test_recall(spark, kind):
    mean, least = recall(spark, made(kind, 7000), list_rows=64)
    assert mean >= 0.9 and least > 0


def test_every_list_gives_the_exact_result(spark):
    assert recall(spark, made("clustered lognormal", 3000), list_rows=64, reach=float("inf"), probes=10**6) == (1.0, 1.0)
