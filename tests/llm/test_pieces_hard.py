"""Sampled pieces of texts that are hard for the lattice."""

import random
import time

import numpy as np

from tarnwork.llm import pieces


def test_sharp_weights_and_unknown_letters(spark):
    rows = [(1, "𐎀𐎁𐎂𐎃𐎄𐎅𐎆𐎇𐎈𐎉𐎊"), (2, "plain words"), (None, "𐎀" * 60), (None, "𐎀" * 60), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = pieces.encode(df, sharpness=2.0).collect()
    assert all(r.lossless for r in out) and len({tuple(r.pieces) for r in out if r.doc_id is None}) == 1


def test_units_that_simple_hashes_confuse(spark):
    letters = lambda a, b: "".join(b if bin(i).count("1") % 2 else a for i in range(4096))
    df = spark.createDataFrame([(1, letters("x", "y")), (2, letters("y", "x"))], "doc_id long, text string").coalesce(1)
    assert all(r.lossless for r in pieces.encode(df).collect())


def test_long_units_are_sampled_as_short_ones():
    m = pieces.lattice(pieces.MODEL, 1.0)
    rng = random.Random(3)
    for _ in range(20):
        unit = np.frombuffer((" " + "".join(rng.choice(["the", "a", "é", "𐎀", "x", "ing"]) for _ in range(9))).encode(), np.uint8)[:40]
        unit = np.frombuffer(unit.tobytes().decode(errors="ignore").encode(), np.uint8)
        (_, end, back, ids, share), low = m.edges(unit, np.array([0]), len(unit))
        _, e, b, i, s = m.long_edges(unit)
        one = {(x, y, z): w for x, y, z, w in zip(end.tolist(), back.tolist(), ids.tolist(), share.tolist())}
        two = {(x, y, z): w for x, y, z, w in zip(e.tolist(), b.tolist(), i.tolist(), s.tolist())}
        assert not len(low) and one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one)


def test_long_text_without_a_space(spark):
    df = spark.createDataFrame([(1, "abcdefghij" * 20_000)], "doc_id long, text string")
    began = time.time()
    assert pieces.encode(df).first().lossless and time.time() - began < 30
