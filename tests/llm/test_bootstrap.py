"""Patterns that find identifiers of forms nobody has listed, round by round."""

import random
import time

from pyspark.sql import functions as F

from tarnwork.llm import pii


def spans(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return {r.doc_id: [x for x in r.spans.split(",") if x] for r in pii.find_personal_data(df, **kw).collect()}


def corpus():
    """Emails under one pattern; under it too, badges of an unlisted form, which also stand under a second pattern with
    tags of a third form, which stand under a third pattern with names."""
    rng = random.Random(1)
    filler = lambda: " ".join(rng.choice("lorem ipsum dolor sit amet was sed".split()) for _ in range(6))
    rows, hidden = [], {1: {}, 2: {}, 3: {}}

    def add(text, value=None, wave=None):
        rows.append((len(rows), text))
        if value:
            at = text.index(value)
            hidden[wave][len(rows) - 1] = f"email:{at}:{at + len(value)}"

    for i in range(40):
        add(f"{filler()} write to account user{i}@mail.com today {filler()}")
    for i in range(8):
        add(f"{filler()} account BX-{i}-QQ{i}. {filler()}", f"BX-{i}-QQ{i}", 1)
        add(f"{filler()} holder BX-{i}-QQ{i} {filler()}", f"BX-{i}-QQ{i}", 1)
    for i in range(5):
        add(f"{filler()} holder zeta{i}kappa, {filler()}", f"zeta{i}kappa", 2)
        for _ in range(2):
            add(f"{filler()} bearer zeta{i}kappa {filler()}", f"zeta{i}kappa", 2)
    for i in range(4):
        add(f"{filler()} bearer omega/{i} {filler()}", f"omega/{i}", 3)
    for i in range(6):
        add(f"{filler()} 12345 {filler()} the account was closed")
    return rows, hidden


def test_recall_rises_by_round(spark):
    rows, hidden = corpus()
    wanted = sum(map(len, hidden.values()))
    found = [sum(span in got.get(d, ()) for wave in hidden.values() for d, span in wave.items()) for got in (spans(spark, rows, rounds=n, least_seeds=4, least_score=0.3) for n in (0, 1, 2, None))]
    assert found[0] == 0 < found[1] < found[2] < found[3] == wanted
    last = spans(spark, rows, least_seeds=4, least_score=0.3)
    assert all(len(last[i]) == 1 for i in range(40)) and not any(last[i] for i in range(len(rows) - 6, len(rows)))


def test_many_matches_take_time_in_proportion(spark):
    took = []
    for n in (2_000, 4_000, 32_000):
        rows = [(1, " ".join(f"10.0.{i % 250}.{i % 99}" for i in range(n)))]
        began = time.time()
        assert len(spans(spark, rows)[1]) == n
        took.append(time.time() - began)
    assert took[2] < 8 * took[1] + 10


def test_oddities(spark):
    rows = [(1, None), (1, None), (None, "a@b.c"), (None, "a@b.c"), (2, ""), (3, " \n "), (4, "a@b.c"), (5, "x a@b.c")] + [(10 + i, f"call +1 (830) 555-{5000 + i} now") for i in range(9)] + [(30, "call 7 now")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"i": F.lit(1), "v": F.lit("x"), "base": F.lit(2), "content": F.lit(3)})
    out = pii.find_personal_data(df)
    assert out.count() == len(rows)
    got = {r.doc_id: r.spans for r in out.collect()}
    assert got[10] == "phone:5:22" and got[None] == "email:0:5" and got[5] == "email:2:7"
    # the one token between the same words fills one slot of ten
    assert got[30] == "phone:5:6"
