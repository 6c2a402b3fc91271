"""Single long lines count as repeated runs."""

import random

import duckdb
import pytest

import corpus_pipeline
from tarnwork.llm import lines

LONG = "the quick brown fox jumps over the lazy dog and runs far away"


def removed(rows):
    """(doc_id, kept text) by plain loops: runs of two lines, and lines of 13 words or more."""
    inked = [[x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")] for _, t in rows]
    out = []
    for (i, t), s in zip(rows, inked):
        gone = set()
        for n in (1, 2):
            earlier = {tuple(o[q : q + n]) for (j, _), o in zip(rows, inked) if j < i for q in range(len(o) - n + 1)}
            for q in range(len(s) - n + 1):
                w = tuple(s[q : q + n])
                if (n == 2 or len(s[q].split()) >= 13) and w in earlier:
                    gone |= set(range(q, q + n))
                earlier.add(w)
        out.append((i, len(s), len(gone)))
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [300, 1_000_000])
def test_long_lines(spark, block_bytes):
    rng = random.Random(6)
    pool = ["a", "b", "c d", " ", "", LONG, LONG + " x", " " + LONG, LONG.rsplit(" ", 1)[0], "é " * 13, "\t".join("abcdefghijklm")]
    rows = [(i // 2 if i % 9 == 0 else i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(7)))) for i in range(40)]
    rows += [(100 + k, f"{LONG} {k % 60}\nonly {k}") for k in range(90)] + [(300, "a"), (301, LONG), (302, LONG)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = lines.remove_repeated_lines(df, block_bytes, long_words=13).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_removed) for r in got) == removed(rows)


def test_words_are_counted_within_a_document(spark):
    rows = [(1, "q"), (2, "a b c d e f g h i j k l m"), (3, "a b c d e f g h i j k l m"), (4, "a b c d e f g h i j k l"), (5, "a b c d e f g h i j k l")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.n_removed for r in lines.remove_repeated_lines(df, long_words=13).collect()} == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0}


def test_pipeline_removes_single_long_lines(spark):
    rows = [(1, f"x\n{LONG}\ny", "en", "s", 9), (2, f"p\n{LONG}\nq", "en", "s", 9), (3, LONG, "en", "s", 9)]
    d = spark.createDataFrame(rows, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema)
    assert {r.doc_id: r.text for r in corpus_pipeline.lines(spark, d, "").collect()} == {1: rows[0][1], 2: "p\nq"}


def test_the_same_as_sql(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}')")
    got = lines.digest(lines.remove_repeated_lines(spark.read.parquet(path), long_words=lines.LONG))
    want = con.sql(lines.SQL_LONG)
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(want.fetchall())
