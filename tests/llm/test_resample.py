"""Importance resampling against a plain version: nulls, repeated ids, ties, longer runs, empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarnwork.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text, most):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)]


def plain(docs, target, most=1, buckets=10_000, seed=2024, least=20, percent=10):
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    rows = [(d, *runs(t, most)) for d, t in docs]
    s = Counter(bucket(x) for _, _, f in rows for x in f)
    t = Counter(bucket(x) for text in target for x in runs(text, most)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for d, n, f in rows:
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    may = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0]))
    for k, x in enumerate(may[: len(may) * percent // 100]):
        x[4] = k + 1
    return [tuple(x[:5]) for x in out]


def made(seed, n=300):
    rng = random.Random(seed)
    some = ["a", "Bee", "é", "x1", "漢字", "the", "of", "q" * 50] + [f"v{k}" for k in range(60)]
    text = lambda size: "".join(rng.choice(some) + rng.choice([" ", ", ", "\n"]) for _ in range(size))
    base = [text(rng.choice([0, 1, 19, 20, 21, 40])) for _ in range(n // 3)]
    docs = [(rng.choice([i, i, i // 2]), rng.choice([rng.choice(base)] * 9 + [None])) for i in range(n)]
    return docs, [rng.choice([text(rng.randrange(20)), None]) for _ in range(20)]


def drawn(spark, docs, target, **options):
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("block", F.lit(1)).repartition(6)
    out = resample.importance_draw(rows, spark.createDataFrame([(t, 1) for t in target], "text string, rank int"), **options)
    assert out.dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
    return [tuple(r) for r in out.collect()]


def ordered(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("options", [{}, {"most": 2, "buckets": 97, "percent": 37}])
def test_draw(spark, options):
    docs, target = made(3)
    got, want = drawn(spark, docs, target, **options), plain(docs, target, **options)
    # equal rows share their score, so either may have the rank
    assert ordered(r[:4] for r in got) == ordered(r[:4] for r in want)
    assert sorted((r[4], r[3], r[0]) for r in got if r[4]) == sorted((r[4], r[3], r[0]) for r in want if r[4])


def test_one_id_on_a_third_of_the_rows(spark):
    docs = [(None if k % 3 == 0 else k, f"w{k % 7} " * 25) for k in range(300)]
    got = drawn(spark, docs, ["w1 w2"], percent=60)
    want = plain(docs, ["w1 w2"], percent=60)
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 181))
    assert ordered((r[3], r[4]) for r in got if r[4]) == ordered((r[3], r[4]) for r in want if r[4])


@pytest.mark.parametrize("docs, target", [([], ["a"]), ([(1, None), (2, ""), (3, "a b")], []), ([(k, "a " * 30) for k in range(30)], [None]), ([(k, "a " * 30) for k in range(30)], ["b"])])
def test_empty_sides(spark, docs, target):
    assert ordered(drawn(spark, docs, target)) == ordered(plain(docs, target))


def test_a_very_long_text(spark):
    docs = [(1, "alpha beta " * 400_000), (2, "gamma " * 30), (3, "x" * 3_000_000)]
    assert ordered(drawn(spark, docs, ["beta"], percent=100)) == ordered(plain(docs, ["beta"], percent=100))
