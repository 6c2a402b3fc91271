"""The pipeline's stages against plain versions, on the small tables and on oddities."""

import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import plain  # noqa: E402

import corpus_pipeline  # noqa: E402
from tarnwork.llm import mixing, pieces  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_do_what_their_plain_versions_do(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = corpus_pipeline.quality(spark, docs, SF).cache()
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    rated = [(r.quality == 1 and r.toxic == 0, i in kept) for i, r in labels.items()]
    assert sum(a == b for a, b in rated) >= 0.9 * len(rated)

    rows = [(r.doc_id, r.text) for r in good.collect()]
    fresh = corpus_pipeline.lines(spark, good, SF).cache()
    want = {i: t for (i, _, cut), (_, t), (_, whole) in zip(plain.long_lines(rows), plain.left(rows), rows) if cut == 0 or len((whole or "").encode()) - len(t.encode()) < 0.75 * len(whole.encode())}
    assert {r.doc_id: r.text or "" for r in fresh.collect()} == want and fresh.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in fresh.collect() if r.text is not None)

    one = corpus_pipeline.near(spark, fresh, SF).cache()
    near = plain.near([(r.doc_id, r.text) for r in fresh.collect()])
    assert sorted(r.doc_id for r in one.collect()) == sorted(i for i, _, _, stays in near if stays)

    mixed = corpus_pipeline.mixture(spark, one, SF).cache()
    taken = {r.doc_id: r for r in mixing.mix_sources(one).collect()}
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
    assert words == Counter({i: r.taken for i, r in taken.items() if r.taken})
    texts = {r.doc_id: r.text.split() for r in one.collect()}
    for r in mixed.collect():
        parts = [texts[r.doc_id][p.start : p.end] for p in taken[r.doc_id].parts]
        assert r.text.split() in (texts[r.doc_id], [w for p in parts for w in p])

    out = corpus_pipeline.segment(spark, mixed, SF)
    assert Counter((r.doc_id, r.text) for r in pieces.decode(out).collect()) == Counter((r.doc_id, r.text) for r in mixed.collect())
