"""Grades against a plain version: tokens one by one, passages by words, the link written out; and the loss of the fit."""

import math
import random
import re

import numpy as np
import pyarrow as pa

from tarnwork.llm import quality
from tarnwork.llm.bytesops import _SYMBOLS, Prefix, arrow_bytes, mix

BITS = 12
SPACE = re.compile(r"[ \t\n\x0b\x0c\r]+")


def bucket(data: bytes, kind: int) -> int:
    return int(Prefix(_SYMBOLS[1][np.frombuffer(data, np.uint8)]).spans(np.array([0]), np.array([len(data)]), kind)[0] >> np.uint64(64 - BITS))


def lower(data: bytes) -> bytes:
    return bytes(b + 32 if 65 <= b <= 90 else b for b in data)


def tokens(data: bytes) -> set[int]:
    letter, digit = rb"[A-Za-z\x80-\xff]+", rb"[0-9]"
    words = re.findall(letter, data)
    out = {bucket(lower(w), 1) for w in words}
    out |= {bucket(lower(w[:n]), 10 + n) for w in words for n in quality.PREFIXES if len(w) > n}
    signs = re.findall(rb"[^A-Za-z\x80-\xff0-9 \t\n\x0b\x0c\r]+", data)
    out |= {bucket(s, 2) for s in signs}
    letters, size = sum(map(len, words)), max(len(data), 1)
    # words are told apart by their buckets
    distinct = len({bucket(lower(w), 1) for w in words})
    bins = [
        math.ceil(10 * len(re.findall(rb"[A-Z]", data)) / max(letters, 1)), math.ceil(20 * sum(map(len, signs)) / size), math.ceil(20 * len(re.findall(digit, data)) / size),
        math.floor(10 * distinct / max(len(words), 1) ** 0.8), math.floor(math.log2(len(words) + 1)), min(math.floor(letters / max(len(words), 1)), 20),
    ]
    return out | {int(mix(np.array([min(v, quality._TOP)], np.uint64), 100 + k)[0] >> np.uint64(64 - BITS)) for k, v in enumerate(bins)}


def passages(text: str) -> list[bytes]:
    """Sixty words each, with all that stands before the next passage's first word."""
    starts = [m.start() for m in re.finditer(r"[^ \t\n\x0b\x0c\r]+", text)]
    cuts = [0, *starts[quality.PASSAGE :: quality.PASSAGE], len(text)]
    return [text[a:z].encode() for a, z in zip(cuts, cuts[1:])]


def grade(model, text: str | None) -> tuple[float, float]:
    if not SPACE.sub("", text or ""):
        return 0.0, 0.0
    scores = [sum(model.weights[t] for t in tokens(p)) for p in passages(text)]
    score = -math.log(sum(math.exp(-s) for s in scores) / len(scores))
    above = [1 - 1 / (1 + math.exp(-(c - score))) for c in model.cuts]
    return sum(above), above[-1]


def made(seed, n):
    rng = random.Random(seed)
    good, bad, toxic = [f"calm{k}" for k in range(40)], [f"ZZ{k}!!" for k in range(40)], [f"vile{k}" for k in range(40)]
    rows = []
    for i in range(n):
        kind = rng.randrange(3)
        words = [rng.choice(good + ["the", "ofé", "12", "x-y"]) for _ in range(rng.choice([1, 30, 59, 60, 61, 200]))]
        for _ in range(max(1, len(words) // 4) if kind < 2 else 0):
            words[rng.randrange(len(words))] = rng.choice(bad if kind == 0 else toxic)
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words), kind))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(k > 0), int(k == 1)) for i, _, k in rows], "doc_id long, quality int, toxic int")
    return docs, labels


def test_grades_equal_the_plain_ones(spark):
    docs, labels = frames(spark, made(1, 240))
    more = spark.createDataFrame([(1000, None), (1001, ""), (1002, " \n"), (1003, "é" * 300), (1004, "calm1 " * 300 + "vile2"), (1005, "?!"), (1006, "  calm3")], "doc_id long, text string")
    every = docs.unionByName(more)
    model = quality.train(every, labels, 40_000, bits=BITS)
    texts = {r.doc_id: r.text for r in every.collect()}
    out = quality.grade_documents(every, labels, bits=BITS).collect()
    assert len(out) == len(texts)
    for r in out:
        mean, top = grade(model, texts[r.doc_id])
        assert abs(r.expected_grade - mean) < 1e-7 and abs(r.p_top - top) < 1e-7 and r.keep == (r.p_top >= 0.5)


def test_the_fit_lowers_the_loss_and_holds_on_other_rows(spark):
    docs, labels = frames(spark, made(2, 400))
    model = quality.train(docs, labels, 40_000, bits=BITS)
    assert list(model.cuts) == sorted(model.cuts) and len(model.cuts) == 2

    def loss(m, rows):
        total = 0.0
        for _, text, kind in rows:
            score = -math.log(sum(math.exp(-sum(m.weights[t] for t in tokens(p))) for p in passages(text)) / len(passages(text)))
            edge = [-40.0, *m.cuts, 40.0]
            # kinds are 0 poor, 1 toxic, 2 sound, as the grades
            total -= math.log(max(1 / (1 + math.exp(score - edge[kind + 1])) - 1 / (1 + math.exp(score - edge[kind])), 1e-9))
        return total / len(rows)

    flat = quality.Ordinal(np.zeros(1 << BITS), np.array([math.log(0.5), math.log(2.0)]))
    held = made(3, 200)
    assert loss(model, held) < 0.5 * loss(flat, held)
    assert sum((grade(model, t)[1] >= 0.5) == (k == 2) for _, t, k in held) >= 190


def test_passages_are_those_of_the_operator():
    texts = ["", "a", "a " * 59 + "b", " a" * 60, "a\n" * 61, "  x " * 200]
    flat, offsets = arrow_bytes(pa.array(texts))
    begin, of = quality.passages(flat, offsets)
    cut = [flat[a:z].tobytes() for a, z in zip(begin, begin[1:])]
    assert [cut[a:z] for a, z in zip(of, of[1:])] == [passages(t) for t in texts]
