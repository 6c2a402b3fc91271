"""Every query gets as many neighbours as it asks for, where so many candidates exist."""

import numpy as np

from tarnwork.llm import postings


def found(spark, x, ids=None, **kw):
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids if ids is not None else range(len(x)), x)], "vec_id long, embedding array<double>")
    got = {}
    for r in postings.nearest_vectors(df, **kw).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return got


def test_small_groups_of_copies(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 64))
    x = np.repeat(x / np.linalg.norm(x, axis=1, keepdims=True), 3, axis=0)
    got = found(spark, x, list_rows=3, sample_rows=1000)
    assert len(got) == 75
    for q, rows in got.items():
        assert sorted(r for r, _, _ in rows) == list(range(1, 21)) and q not in {v for _, v, _ in rows} and len({v for _, v, _ in rows}) == 20
        copies = {3 * (q // 3) + j for j in range(3)} - {q}
        assert copies <= {v for _, v, _ in rows}


def test_the_search_widens_without_end():
    c = np.arange(100.0)[:, None]
    take = lambda need, homes, n=5: postings.chosen(c[0], c, np.arange(n), np.arange(float(n)), 1.25, homes, need).tolist()
    one = np.ones(100, np.int64)
    assert take(3, one, 20) == list(range(8)) and take(12, one, 20) == list(range(12))
    assert take(30, one) == list(range(30)) and take(1000, one) == list(range(100))
    assert take(2, np.where(np.arange(100) < 90, 0, 1)) == list(range(92))
