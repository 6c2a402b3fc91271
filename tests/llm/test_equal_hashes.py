"""Phrases and shingles whose hashes are all equal: content decides."""

import random

import numpy as np
import pyarrow as pa

from tarnwork.llm import neardup, phrases
from tarnwork.llm.bytesops import arrow_bytes, word_spans


class Same:
    """Stands for prefix sums of which every span has one hash."""

    def __init__(self, symbols):
        self.n = len(symbols)

    def grams(self, k, salt=0):
        return np.zeros(max(self.n - k + 1, 0), np.uint64)

    def spans(self, start, end, salt=0):
        return np.zeros(len(start), np.uint64)


def test_passages_of_one_hash(monkeypatch):
    rng = random.Random(1)
    n = 3
    for _ in range(30):
        texts = [[rng.randrange(4) for _ in range(rng.randrange(n, 9))] for _ in range(8)]
        owner = np.sort(np.array([rng.randrange(5) for _ in texts]))
        number, count = np.array(sum(texts, [])), np.array([len(t) - n + 1 for t in texts])
        first = {}
        for t, o in zip(texts, owner):
            for i in range(len(t) - n + 1):
                first.setdefault(tuple(t[i : i + n]), o)
        want = sorted((e, i) for e, (t, o) in enumerate(zip(texts, owner)) for i in range(len(t) - n + 1) if first[tuple(t[i : i + n])] < o)
        found = []
        for fake in (False, True):
            with monkeypatch.context() as m:
                if fake:
                    m.setattr(phrases, "Prefix", Same)
                entries, places = phrases.locate(number, count, owner, n, np.zeros(len(texts), np.uint64))
            found.append(sorted(zip(entries.tolist(), places.tolist())))
        assert found[0] == found[1] == want


def test_shingles_of_one_hash(monkeypatch):
    texts = ["a b c d e f g", "a b c d e a b c d e", "a a a a a a a", "a b", "", "x y z x y z x y z x y z"]
    flat, offsets = arrow_bytes(pa.array(texts))
    start, end, cuts = word_spans(flat, offsets)
    want = [len({tuple(t.split()[i : i + 5]) for i in range(max(len(t.split()) - 4, 1))}) if t else 0 for t in texts]
    assert neardup.shingles(flat, start, end, cuts)[2].tolist() == want
    monkeypatch.setattr(neardup, "Prefix", Same)
    assert neardup.shingles(flat, start, end, cuts)[2].tolist() == want
