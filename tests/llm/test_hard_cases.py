"""Unlike texts that simple polynomial hashes can't tell apart; columns of any name; very long texts."""

import random
import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
import plain  # noqa: E402

from tarnwork.llm import lines, mixing, neardup, phrases, suffixes  # noqa: E402
from tarnwork.llm.bytesops import byte_grams, span_hash  # noqa: E402


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


def pattern(n, a, b):
    """The Thue-Morse sequence in two letters; with the letters exchanged, any polynomial hash modulo 2**64 is the same from some length on."""
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


ONE, TWO = pattern(4096, "x", "y"), pattern(4096, "y", "x")


def test_unlike_lines_stay(spark):
    rows = [(1, f"{ONE}\n{TWO}\nend"), (2, f"{TWO}\n{ONE}\nend"), (3, f"{ONE}\n{ONE}\nq"), (4, f"{ONE}\n{TWO}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(lines.digest(lines.remove_repeated_lines(df)).collect()) == ordered(plain.lines(rows))


def test_unlike_words_stay(spark):
    same = " ".join(f"w{k}" for k in range(12))
    rows = [(1, f"{ONE} {same}"), (2, f"{TWO} {same}"), (3, f"{ONE} {same} z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(phrases.digest(phrases.remove_phrases(df)).collect()) == ordered(plain.phrases(rows))


def test_unlike_shingles_are_not_linked(spark):
    rows = [(1, f"{ONE} a b c d"), (2, f"{TWO} a b c d"), (3, f"{ONE} a b c d"), (4, f"{TWO.upper()} a B c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(neardup.near_duplicates(df).collect()) == ordered(plain.near(rows))


def test_bytes_of_one_kind(spark):
    rows = [(1, "a" * 3000), (2, "b" * 20 + "a" * 49), (3, "a" * 60 + "b" * 70), (4, ONE), (5, TWO), (6, "\0" * 70), (7, "\0" * 49), (8, "c" + "\0" * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(suffixes.digest(suffixes.remove_repeats(df, block_bytes=4000)).collect()) == ordered(plain.suffixes(rows))


def test_hash_of_spans_depends_on_the_bytes_alone():
    rng = np.random.default_rng(1)
    flat = rng.integers(0, 3, 4000).astype(np.uint8)
    start = rng.integers(0, 3900, 500)
    end = start + rng.integers(0, 100, 500)
    h = span_hash(flat, start, end)
    seen = {}
    for a, z, x in zip(start, end, h):
        assert seen.setdefault(flat[a:z].tobytes(), x) == x
    assert len(set(seen.values())) == len(seen)
    g = byte_grams(flat, 24)
    assert len(g) == 4000 - 23 and len(np.unique(g)) == len({flat[i : i + 24].tobytes() for i in range(len(g))})


def test_no_tree_no_order(spark, monkeypatch):
    """What is removed rests on the merged order and on its common prefixes."""
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice(["ab", "c", "é ", "xyz"]) for _ in range(60))) for i in range(30)]
    rows += [(100 + i, t[20:]) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kind = suffixes.Suffixes(50, 24)
    parts = [[], []]
    for k, half in enumerate((rows[:30], rows[30:])):
        flat = np.frombuffer("".join(t for _, t in half).encode(), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for _, t in half])])
        w = kind.windows(type("Block", (), {"flat": flat, "offsets": offsets, "ids": np.array([i for i, _ in half])}))
        rows_of = kind.rows(w, np.arange(len(w.first)))
        order = kind.order(rows_of, np.zeros(len(rows_of), np.int64))
        parts[k] = kind.runs(w, order, rows_of[order], w.owner[order], np.array([0]), np.array([len(order)]))[0]
    right = kind.combine(parts)
    assert len(right[1])
    monkeypatch.setattr("tarnwork.llm.suffixes.merge", lambda runs, shared: ([r for r, x in enumerate(runs) for _ in x[0]], [i for x in runs for i in range(len(x[0]))], [c for x in shared for c in x]))
    wrong = kind.combine(parts)
    assert ordered(zip(*right[1:])) != ordered(zip(*wrong[1:]))
    monkeypatch.undo()
    assert ordered(suffixes.digest(suffixes.remove_repeats(df)).collect()) == ordered(plain.suffixes(rows))


def test_no_automaton_no_removal(spark, monkeypatch):
    class Nothing:
        def iter(self, _):
            return iter(())

    number = np.array([*range(20), *range(20)])
    count, owner = np.array([8, 8]), np.array([1, 2])
    entry, place = phrases.locate(number, count, owner, 13, np.zeros(2, np.uint64))
    assert entry.tolist() == [1] * 8 and place.tolist() == list(range(8))
    monkeypatch.setattr(phrases, "automaton", lambda *a: Nothing())
    assert not len(phrases.locate(number, count, owner, 13, np.zeros(2, np.uint64))[0])


def test_columns_of_any_name(spark):
    names = "_ _absent_text _kept _nth _taken _size _doc _src _whole _salt block n_removed key root u v"
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names.split()) + ", `a.b` string"
    rows = [(i, f"line {i % 3} of some words\nand line {i % 3} more of them", "en", "s", 1, *range(16), "x") for i in range(6)]
    df = spark.createDataFrame(rows, schema)
    cut = lines.remove_repeated_lines(df)
    assert cut.columns[: len(df.columns)] == df.columns and cut.select("`a.b`", "_kept", "key").distinct().count() == 1
    assert ordered(neardup.keep_one(df).collect()) == ordered(r for r in rows if r[0] < 3)
    took = mixing.take(df)
    assert took.columns == df.columns and took.count() >= 6


def test_one_very_long_text(spark):
    rng = random.Random(12)
    long = " ".join(rng.choice("abcdefgh") for _ in range(30_000))
    rows = [(1, long), (2, long[1000:3000]), (3, None), (4, "x" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(phrases.digest(phrases.remove_phrases(df)).collect()) == ordered(plain.phrases(rows))
    assert ordered(suffixes.digest(suffixes.remove_repeats(df)).collect()) == ordered(plain.suffixes(rows))


def test_copies_that_are_only_near_their_original(spark):
    """The original comes last and the copies are far from each other: all are linked, through it."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for at in range(i % 11, 120, 40):
            w[at] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows.append((1000, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(neardup.near_duplicates(df).collect()) == ordered(plain.near(rows))


def test_sketches_differ_in_no_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, rng.integers(1, 300), replace=False)) for _ in range(40)]
    bits = neardup.sketches(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])]))
    for i in range(40):
        for j in range(i):
            assert np.bitwise_count(bits[i] ^ bits[j]).sum() <= len(np.setxor1d(sets[i], sets[j]))
