"""Corpus operators against plain versions, on rows with nulls, ties, repeats and empty texts."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import plain  # noqa: E402

import corpus_pipeline  # noqa: E402
from tarnwork.llm import bitsliced, lines, losertree, mixing, neardup, phrases, pieces, pii, postings, quality, queries, suffixes  # noqa: E402
from tarnwork.llm.components import components  # noqa: E402

SF = "/root/testdata/sf0.001"


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def docs(rng, words, n, most, glue=" "):
    base = [[rng.choice(words) for _ in range(rng.choice((0, 1, 5, 12, 13, 14, 40, most)))] for _ in range(n // 4)]
    rows = []
    for i in range(n):
        text = glue.join(sum((rng.choice(base)[rng.randrange(9) :][: rng.randrange(most)] for _ in range(rng.randrange(4))), []))
        rows.append((rng.choice([i, i, i, None, i // 2]), rng.choice([text] * 9 + [None])))
    return rows


@pytest.mark.parametrize("block_bytes", [700, 1_000_000])
def test_repeated_phrases(spark, block_bytes):
    rows = docs(random.Random(3), "a b c é".split(), 150, 90)
    assert ordered(phrases.digest(phrases.remove_phrases(table(spark, rows), block_bytes)).collect()) == ordered(plain.phrases(rows))


@pytest.mark.parametrize("block_bytes", [2000, 1_000_000])
def test_repeated_bytes(spark, block_bytes):
    rows = docs(random.Random(4), ["ab", "c", "é ", "xyz"], 120, 200, "")
    assert ordered(suffixes.digest(suffixes.remove_repeats(table(spark, rows), block_bytes=block_bytes)).collect()) == ordered(plain.suffixes(rows))


@pytest.mark.parametrize("block_bytes", [300, 1_000_000])
def test_repeated_lines(spark, block_bytes):
    rows = docs(random.Random(5), ["a", "b", "c d", "é", " ", "", "\t", "x\r", "long line of words"], 200, 20, "\n")
    assert ordered(lines.digest(lines.remove_repeated_lines(table(spark, rows), block_bytes)).collect()) == ordered(plain.lines(rows))


def test_lines_carry_other_columns(spark):
    df = spark.createDataFrame([(1, "a\nb", 7, ["x"]), (2, "q\na\nb", None, None), (3, None, 1, [])], "doc_id long, text string, n_lines int, block array<string>")
    out = {r.doc_id: r for r in lines.remove_repeated_lines(df).collect()}
    assert out[1].text == "a\nb" and out[2].text == "q" and out[3].text is None
    assert (out[1].n_lines, out[1].block, out[2].n_lines, out[2].n_removed) == (7, ["x"], None, 2)


def test_near_duplicates(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(40)]
    base = [[rng.choice(words) for _ in range(rng.choice((0, 1, 3, 4, 5, 6, 30, 60)))] for _ in range(25)]
    rows = []
    for i in range(300):
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2, 3))):
            if w:
                w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((rng.choice([i, i, i, None, i // 2]), rng.choice([" ".join(w)] * 9 + [None, " ".join(w).upper()])))
    assert ordered(neardup.near_duplicates(table(spark, rows), block_bytes=2000).collect()) == ordered(plain.near(rows))


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(rng.randrange(7)):
            w[rng.randrange(60)] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    assert ordered(neardup.near_duplicates(table(spark, rows)).collect()) == ordered(plain.near(rows))


@pytest.mark.parametrize("edges_of_a_task", [3, 1000])
def test_components_of_a_chain(spark, monkeypatch, edges_of_a_task):
    monkeypatch.setattr("tarnwork.llm.components.EDGES", edges_of_a_task)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_loser_tree():
    rng = random.Random(8)
    runs = [sorted([rng.randrange(5), rng.randrange(3)] for _ in range(rng.randrange(1, 30))) for _ in range(7)]
    shared = [[0] + [0 if a[0] != b[0] else 2 if a == b else 1 for a, b in zip(r, r[1:])] for r in runs]
    run, at, common = losertree.merge([[[x[0] for x in r], [x[1] for x in r]] for r in runs], shared)
    merged = [runs[r][i] for r, i in zip(run, at)]
    assert merged == sorted(x for r in runs for x in r)
    assert common[1:] == [0 if a[0] != b[0] else 2 if a == b else 1 for a, b in zip(merged, merged[1:])]


TOKENS = ["a@b.c", "x.y@z", "a@b.c_d@e.f", "é🎉", "1.2.3.4", "1.2.3.4.5", "300.1.1.1", "001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (830) 555-5433", "+123", "@", "a@b@c.d", ".", "1", "22", "\n", "+4915112345678", "5500005555555559", "00000000000000", "1.2.3.4 5500 0055 5555 5559"]


def test_personal_data_forms(spark):
    rng = random.Random(2)
    rows = [(rng.choice([i, None, i // 2]), rng.choice(["", " "]).join(rng.choice(TOKENS) for _ in range(rng.randrange(12))) if rng.random() < 0.95 else None) for i in range(400)]
    assert ordered(pii.find_personal_data(table(spark, rows), least_score=2).collect()) == ordered(plain.personal(rows))


def test_personal_data_patterns(spark):
    rows = [(i, f"foo bar end Account: user{i}@mail.com the") for i in range(30)] + [(100 + i, f"zip Account: AB{10000 + i * 13} and the {20000 + i}") for i in range(3)] + [(200, "the 1234567")]
    out = {r.doc_id: r for r in pii.find_personal_data(table(spark, rows)).collect()}
    assert out[101].spans == "email:13:20" and out[101].n_spans == 1 and out[101].n_email == 0 and out[101].base_sha256 == plain.sha("")
    assert out[200].spans == "" and out[3].spans.startswith("email:21:")


def test_mixture_meets_targets(spark):
    rng = random.Random(9)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(200))), rng.choice(["a"] * 5 + ["b", "c", None])) for i in range(500)] + [(None, None, "a"), (3, "", "b"), (3, "", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_sources(df, shard_words=2000).collect()
    again = mixing.mix_sources(df.repartition(3), shard_words=2000).collect()
    assert ordered(out) == ordered(again) and len(out) == len(rows)
    size, taken, target = {}, {}, {}
    for r in out:
        size[r.source] = size.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sum(len((t or "").split()) for _, t, s in rows if s == r.source)
    total, weight = 1.5 * sum(size.values()), {"a": 5, "b": 2, "c": 1, None: 5}
    goal, left, free = {}, total, set(size)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 2 * size[s]}
        if not full:
            goal |= share
            break
        goal |= {s: 2 * size[s] for s in full}
        left, free = left - sum(2 * size[s] for s in full), free - full
    for s in size:
        assert abs(target[s] - goal[s]) < 1e-6 * total and abs(taken[s] - goal[s]) <= 0.01 * goal[s] + 2
    took = mixing.take(df, shard_words=2000)
    assert took.columns == df.columns and took.agg(F.sum(F.size(F.split("text", " ")))).first()[0] == sum(taken.values())


def test_apportionment_has_the_highest_quotients(spark):
    rng = random.Random(10)
    for _ in range(5):
        shares, seats = [rng.random() ** 3 for _ in range(9)], rng.randrange(1, 60)
        quota = [0] * 9
        for _ in range(seats):
            quota[max(range(9), key=lambda k: shares[k] / (2 * quota[k] + 1))] += 1
        df = spark.createDataFrame([(0, k, s, seats) for k, s in enumerate(shares)], "g int, k int, share double, seats long")
        assert [r.quota for r in mixing.apportion(df, ["g"], "share", "seats", "k").orderBy("k").collect()] == quota


TEXTS = ["", None, " ", "a  b\n\n ▁x ▁▁ 日本語𝔘🎉", "x" * 500, "\t\r\n", "  lead", "<0x0A> <s>", "the words of this text", "the words of this text"]


def test_pieces_are_lossless_and_reproducible(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS[:-1])) + [(8, TEXTS[-1])], "doc_id long, text string")
    one = pieces.encode(df)
    two = pieces.encode(df.repartition(4))
    assert ordered(one.collect()) == ordered(two.collect()) and all(r.lossless for r in one.collect())
    assert {r.doc_id: r.text for r in pieces.decode(one).collect()} == {i: t or "" for i, t in enumerate(TEXTS[:-1])}
    assert ordered(pieces.encode(df, seed=12).collect()) != ordered(one.collect())


def test_pieces_are_sampled_by_their_lattice():
    m = pieces.lattice(pieces.MODEL, 1.0)
    text = b"them"
    ways = {}

    def walk(at, ids, p):
        if at == 5:
            ways[tuple(ids)] = p
        for size in range(1, 6 - at):
            piece = m.words.get(b" them"[at : at + size])
            if piece is not None:
                walk(at + size, [*ids, piece], p * m.weight[piece])

    walk(0, [], 1.0)
    n = 20_000
    ids, cuts = pieces.sample(m, np.frombuffer(text * n, np.uint8), np.arange(n + 1) * 4, np.arange(n), 1)
    seen = {}
    for a, b in zip(cuts[:-1], cuts[1:]):
        seen[tuple(ids[a:b].tolist())] = seen.get(tuple(ids[a:b].tolist()), 0) + 1
    assert set(seen) <= set(ways)
    for k, p in ways.items():
        assert abs(seen.get(k, 0) / n - p / sum(ways.values())) < 0.015


def brute_top(vectors, k, score, own):
    out = []
    for i, v in vectors:
        if i % 20 == 0:
            best = sorted((-score(v, w), j) for j, w in vectors if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def vectors(rng):
    rows = []
    for i in range(130):
        v = [rng.choice([0.0, 0.02, -0.03, 1.5, -7.0]) for _ in range(5)]
        rows.append((rng.choice([i, i, 20, None]), rng.choice([v] * 9 + [None, v[:3], [], v[:2] + [None], v[:2] + [float("nan")], v[:1] + [float("inf")]])))
    return rows + rows[:10] + [(1000 + i, [1.0, 2.0, 3.0]) for i in range(60)]


def test_exact_top(spark):
    rows = vectors(random.Random(11))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    fine = {(i, tuple(np.float32(v))) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    ints = sorted({(i, (*(int(np.floor(64 * float(x))) for x in v), *[0] * (5 - len(v)))) for i, v in fine})
    want = brute_top(ints, 20, lambda a, b: sum(x * y for x, y in zip(a, b)), None)
    assert sorted(tuple(r) for r in bitsliced.exact_top(df, rows=50, query_rows=3).collect()) == want


def test_nearest_vectors_recall(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 16)).astype(np.float32)
    x[:1500] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in postings.nearest_vectors(df, list_rows=100, part_rows=300).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    d, hits = x.astype(np.float64), 0
    for q, found in got.items():
        s = d @ d[q]
        s[q] = -np.inf
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(abs(score - s[v]) < 1e-9 for _, v, score in found)
        hits += sum(score >= np.sort(s)[-20] - 1e-9 for _, _, score in found)
    assert len(got) == 200 and hits / (20 * len(got)) >= 0.9


def test_nearest_vectors_oddities(spark):
    rows = [(5, None), (None, [1.0]), (6, [0.0, 0.0]), (7, [float("nan")]), (8, []), (20, [1.0, 0.0]), (21, [1.0, 0.0]), (22, [0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [tuple(r) for r in postings.nearest_vectors(df).orderBy("rank").collect()] == [(20, 1, 21, 1.0), (20, 2, 22, 0.5)]


def test_quality_on_held_out_rows(spark):
    d, lab = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = quality.grade_documents(d, lab.filter("doc_id % 4 <> 0")).join(lab.filter("doc_id % 4 = 0"), "doc_id").toPandas()
    clean, junk = held[(held.quality == 1) & (held.toxic == 0)], held[held.quality == 0]
    assert clean.keep.mean() > 0.98 and junk.keep.mean() < 0.1
    assert (held.keep == ((held.quality == 1) & (held.toxic == 0))).mean() > 0.9
    assert held.expected_grade.between(0, 2).all()


def test_quality_without_labels(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, " ")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.doc_id: (r.expected_grade, r.keep) for r in quality.grade_documents(df, none).collect()} == {1: (None, True), 2: (None, False), 3: (None, False)}


def test_thresholds_are_ordered_and_monotone():
    m = quality.Ordinal(np.zeros(4), np.array([-1.0, 2.0]))
    grade, top = m.grades(np.linspace(-9, 9, 50))
    assert (np.diff(grade) > 0).all() and (np.diff(top) > 0).all() and grade[0] < 0.01 and grade[-1] > 1.99


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables(spark, name, tmp_path):
    for t in ("documents", "embeddings", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_pipeline(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    before = d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == d.columns and after.count() > 0, name
        before = after
    out = corpus_pipeline.run(spark, SF)
    assert out.filter("NOT lossless").count() == 0 and out.count() == before.count()


def test_pipeline_stages_on_oddities(spark):
    rows = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (None, "x y", None, None, None), (2, None, "en", "s", 0), (3, "", "en", None, 0), (4, "q " * 20000, "en", "s", 40000)]
    d = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, d, SF).collect()
        assert stage(spark, d.limit(0), SF).count() == 0, name
    kept = corpus_pipeline.near(spark, d, SF).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "3", "4", "None"]
