"""Importance resampling towards a target's words, over a sparse count matrix kept in CSR blocks.

Every document is a row of counts by hash bucket. The matrix is written once, in blocks of packed rows
(offsets, buckets, counts). Its column sums give the corpus' distribution, the target's its own; the log
ratio of both is a vector of gains by bucket, and the product of the matrix with it gives the weights.
Rows are drawn by weight plus seeded Gumbel noise, the highest first.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.blocks import get_ints, put_ints
from tarnwork.llm.bytesops import arrow_bytes, give_back, pieces
from tarnwork.llm.common import cut, documents, partitions
from tarnwork.llm.words import Words

#: Rows are packed by about this many bytes of text.
BLOCK = 4_000_000


def bucket_of(w: Words, first: np.ndarray, last: np.ndarray, buckets: int) -> np.ndarray:
    """crc32 of each run of words, joined by one space, modulo ``buckets``; equal runs are hashed once."""
    start, end = w.first[first], w.stop[last]
    size = end - start
    cuts = np.concatenate([[0], np.cumsum(size)])
    text = w.text[np.arange(cuts[-1]) + np.repeat(start - cuts[:-1], size)]
    runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(text)])
    coded = runs.dictionary_encode()
    code = np.fromiter((zlib.crc32(x) % buckets for x in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
    return code[coded.indices.to_numpy()]


def counts(w: Words, buckets: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The documents' rows as CSR: offsets, buckets ascending within a row, counts. ``most``: longest run of words."""
    n = len(w.cuts) - 1
    keys = []
    for k in range(1, most + 1):
        first, last, doc = w.grams(k)
        keys.append(doc * buckets + bucket_of(w, first, last, buckets))
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    return np.searchsorted(key, np.arange(n + 1) * buckets), key % buckets, count


def matrix(docs: DataFrame, buckets: int, most: int) -> DataFrame:
    """(block, rows, n_words, data): CSR blocks of documents, checkpointed; doc_ids come packed with them."""

    def pack(it):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 24
        for batch in it:
            flat, offsets = arrow_bytes(batch.column("text"))
            for lo, hi in pieces(offsets, BLOCK):
                w = Words(flat[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                cuts, bucket, count = counts(w, buckets, most)
                ids = batch.column("doc_id").slice(lo, hi - lo)
                null = ids.is_null().to_numpy(zero_copy_only=False)
                data = put_ints((cuts, True), (bucket, False), (count, False), (ids.fill_null(0).to_numpy(zero_copy_only=False), False), (null, False), (w.counts(), False))
                yield pa.RecordBatch.from_pydict({"block": pa.array([block]), "data": pa.array([data], pa.binary())})
                block += 1
            give_back()

    return cut(documents(docs).mapInArrow(pack, "block long, data binary"))


def _rows(data: bytes) -> list[np.ndarray]:
    return [x.view(np.int64) for x in get_ints(data)]


def column_sums(blocks: DataFrame, buckets: int) -> np.ndarray:
    """Features of each bucket in all rows: one partial row of sums for each task."""

    def add(it):
        total = np.zeros(buckets, np.int64)
        for batch in it:
            for data in batch.column("data").to_pylist():
                _, bucket, count, *_ = _rows(data)
                # sums of integers below 2**53 are exact in doubles
                total += np.bincount(bucket, count, buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    # a row for each bucket at most
    for r in blocks.select("data").mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow().to_pylist():
        out[r["bucket"]] = r["n"]
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray, scale: float = 1000.0) -> np.ndarray:
    """floor(scale * ln) of the smoothed ratio of both distributions, by bucket."""
    k, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(scale * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weights(blocks: DataFrame, gains: np.ndarray) -> DataFrame:
    """(block, nth, doc_id, n_words, n_features, weight): the matrix times the gains, over each row's features."""

    def multiply(it):
        for batch in it:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist()):
                cuts, bucket, count, ids, null, words = _rows(data)
                total = np.concatenate([[0], np.cumsum(count)])[cuts]
                gain = np.concatenate([[0], np.cumsum(gains[bucket] * count)])[cuts]
                n = np.diff(total)
                weight = np.diff(gain) // np.maximum(n, 1)
                rows = [pa.array(np.full(len(n), block)), pa.array(np.arange(len(n))), pa.array(ids, mask=null.astype(bool)), pa.array(words), pa.array(n), pa.array(weight)]
                yield pa.RecordBatch.from_arrays(rows, names=["block", "nth", "doc_id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(multiply, "block long, nth long, doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, order: list, rank: str = "rank") -> DataFrame:
    """Numbers all rows by ``order`` from 1: sorted by ranges, each range's rows counted, and no range moved after that."""
    placed = cut(rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order))
    at = placed.withColumn("_at", F.monotonically_increasing_id())
    at = at.withColumn("_range", F.shiftright("_at", 33).cast("int"))
    # a row for each range
    before, total = [], 0
    for r in sorted(at.groupBy("_range").count().collect()):
        before.append((r["_range"], total))
        total += r["count"]
    before = rows.sparkSession.createDataFrame(before, "_range int, _before long")
    nth = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return at.join(F.broadcast(before), "_range").withColumn(rank, F.col("_before") + nth + 1).drop("_at", "_range", "_before")


def importance_draw(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10) -> DataFrame:
    """Weighs every document by how much likelier its words are in ``target``, and draws ``percent`` of them.

    Features are all runs of 1 to ``most`` words, by crc32 modulo ``buckets``. Returns doc_id, n_features, weight, score
    and, for the documents drawn, rank. Null and empty texts have no features and weight 0, on either side; without
    features on a side its distribution is even. Rows that repeat a doc_id are documents of their own with equal noise;
    of equal scores the smaller doc_id comes first, a null one (its noise is that of an empty id) last. Only documents of
    ``least_words`` words are drawn. An empty table gives an empty result; other columns, of any name, don't matter.
    """
    blocks = matrix(docs, buckets, most)
    wanted = matrix(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets, most)
    gains = gains_of(column_sums(blocks, buckets), column_sums(wanted, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = cut(weights(blocks, gains).withColumn("score", F.col("weight") + noise))
    may = F.col("n_words") >= least_words
    # scores are whole numbers, some 100,000 different ones at most by the logarithms' range: a row for each tells the least drawn
    tally = sorted(((r["score"], r["count"]) for r in scored.filter(may).groupBy("score").count().collect()), reverse=True)
    draw = sum(n for _, n in tally) * percent // 100
    least, above = None, 0
    for score, n in tally:
        if above >= draw:
            break
        least, above = score, above + n
    out = ["doc_id", "n_features", "weight", "score"]
    if least is None:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    in_reach = may & (F.col("score") >= least)
    # block and place tell equal rows apart, so that a doc_id of many rows is dealt to many ranges
    first = ranked(scored.filter(in_reach), [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("block"), F.col("nth")])
    first = first.select(*out, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank"))
    return first.unionByName(scored.filter(~in_reach).select(*out, F.lit(None).cast("long").alias("rank")))


#: crc32 by a table of 256 entries, made by its rule, over the bytes of each distinct word.
SQL = """
WITH RECURSIVE c(i, k, x) AS (SELECT range, 0, range FROM range(0, 256) UNION ALL SELECT i, k + 1, CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM c WHERE k < 8),
tab AS (SELECT list(x ORDER BY i) AS t FROM c WHERE k = 8),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
dw AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM d) GROUP BY ALL),
bw AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM b) GROUP BY ALL),
v AS (SELECT word, hex(word) AS h FROM (SELECT DISTINCT word FROM dw UNION SELECT word FROM bw)),
k AS (SELECT word, xor(list_reduce(list_transform(range(-1, len(h) // 2), lambda i: CASE WHEN i < 0 THEN 4294967295 ELSE CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT) END),
      lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM v, tab),
s AS (SELECT bucket, sum(n) AS s FROM dw JOIN k USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM bw JOIN k USING (word) GROUP BY bucket),
z AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS s_all, (SELECT coalesce(sum(t), 0) FROM t) AS t_all),
g AS (SELECT s.bucket, floor(1000 * ln((coalesce(t.t, 0) + 1.0::DOUBLE) * (s_all + 10000) / ((s.s + 1.0::DOUBLE) * (t_all + 10000)))) AS gain FROM s LEFT JOIN t ON s.bucket = t.bucket, z),
w AS (SELECT doc_id, floor(sum(n * gain) / sum(n)) AS weight FROM dw JOIN k USING (word) JOIN g USING (bucket) GROUP BY doc_id),
a AS (SELECT d.doc_id, len(d.w) AS n, CAST(coalesce(w.weight, 0) AS BIGINT) AS weight,
      CAST(coalesce(w.weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN w ON d.doc_id = w.doc_id),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM a WHERE n >= 20)
SELECT a.doc_id, a.n AS n_features, a.weight, a.score, r.rank
FROM a LEFT JOIN (SELECT * FROM r WHERE rank <= (SELECT count(*) FROM r) * 10 // 100) r ON a.doc_id = r.doc_id
"""
