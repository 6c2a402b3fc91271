"""Benchmark passages against a plain version: nulls, short items, repeats, shards, strings of one hash."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.llm import wumanber

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, n=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - n + 1, min(len(w), 1))):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, who = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (x := tuple(w[i : i + size])) in windows:
                    hit |= set(range(i, i + size))
                    who |= {str(k) for k in windows[x] if k is not None}
        out.append((doc, len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def made(seed, n_docs=120, n_items=40):
    rng = random.Random(seed)
    some = ["a", "B", "bé", "É", "x1", "77", "the", "漢字", "of", "q" * 40]
    sep = [" ", "  ", ", ", "\n", "-", "_", "\x7f", "!?"]
    text = lambda n: "".join(rng.choice(some) + rng.choice(sep) for _ in range(n))
    items = [(rng.choice([i, i, i // 2, None]), rng.choice([text(rng.choice([0, 1, 3, 9, 10, 11, 30]))] * 9 + [None])) for i in range(n_items)]
    docs = []
    for i in range(n_docs):
        parts = [rng.choice([text(rng.randrange(30)), (rng.choice(items)[1] or "").upper() if rng.random() < 0.5 else rng.choice(items)[1] or ""]) for _ in range(rng.randrange(4))]
        docs.append((rng.choice([i, i, i // 2, None]), rng.choice([rng.choice(["", " ", "-"]).join(parts)] * 9 + [None])))
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_words", F.lit(1)).repartition(5), spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x"))


def found(spark, docs, items, **options):
    return sorted((tuple(r) for r in wumanber.digest(wumanber.passages_in(*frames(spark, docs, items), **options)).collect()), key=str)


@pytest.mark.parametrize("shard_bytes", [4_000_000, 500])
@pytest.mark.parametrize("seed", [1, 2])
def test_passages(spark, seed, shard_bytes):
    docs, items = made(seed)
    assert found(spark, docs, items, shard_bytes=shard_bytes) == plain(docs, items)


def test_long_items_only(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}é" for k in range(9)] + [f"word{k}" for k in range(9)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(60))) for k in range(30)]
    docs = [(k, " ".join([rng.choice(vocabulary) for _ in range(40)] + items[k % 30][1].split()[k % 7 : 9 + k % 50])) for k in range(200)]
    assert found(spark, docs, items) == plain(docs, items)


def test_parts_of_long_items(spark, monkeypatch):
    monkeypatch.setattr(wumanber, "PART_WORDS", 13)
    docs, items = made(4)
    items += [(99, " ".join(f"v{k}" for k in range(200)))]
    docs += [(1000, " ".join(f"v{k}" for k in range(3, 180)))]
    # tasks import the module anew, so the parts are made here
    parts = {(r.item_id, r.text) for r in wumanber.item_parts(spark.createDataFrame(items, "item_id long, text string"), 10).collect()}
    assert plain(docs, [(int(i) if i else None, t) for i, t in parts]) == plain(docs, items)


@pytest.mark.parametrize("docs, items", [([], [(1, "a b")]), ([(1, "a b"), (2, None), (3, "")], []), ([(1, "a b")], [(1, None), (2, " !")])])
def test_nothing_to_find(spark, docs, items):
    assert found(spark, docs, items) == plain(docs, items)


def test_equal_hashes_cost_work_only(monkeypatch):
    docs, items = made(6, 40)
    from tarnwork.llm.bytesops import arrow_bytes
    import pyarrow as pa

    monkeypatch.setattr(wumanber, "span_hash", lambda flat, start, end, salt=0: np.zeros(len(start), np.uint64))
    monkeypatch.setattr(wumanber, "mix", lambda x, salt=0: np.zeros(len(x), np.uint64))
    p = wumanber.Passages(pa.array([t or "" for _, t in items]), [None if i is None else str(i) for i, _ in items])
    w = wumanber.Words(*arrow_bytes(pa.array([t for _, t in docs])))
    start, end, number = p.scan(w)
    hit = wumanber.cover(len(w.first), start, end)
    got = [int(hit[a:z].sum()) for a, z in zip(w.cuts, w.cuts[1:])]
    assert got == [len_hit for len_hit in (plain([d], items)[0][2] for d in docs)]


def test_one_very_long_document(spark):
    text = "x y z " * 300_000 + "one two three four five six seven eight nine ten eleven"
    items = [(7, "One two three four five six seven eight nine ten"), (8, "ten eleven")]
    assert found(spark, [(1, text)], items) == [(1, 900_011, 11, 2, hashlib.sha256(b"7,8").hexdigest(), True)]
