"""Near duplicates by b-bit MinHash.

A document's set holds its distinct word shingles. 192 minima make 48 bands of 4; the two low bits of
each minimum, packed in six longs, estimate similarity by bit counts, corrected for chance collisions.
A link of similarity 0.75 shares no band once in 85 million cases, one of 0.8 once in 10^11. Estimates
only discard what is far off (under ``least - margin``, over six standard errors); every link is
confirmed on the words themselves.

Groups of copies don't make pairs: documents of equal words are one node (by SHA-256 of their words),
and in a band's bucket all members are first compared with one leader, the member that meets most others
in all bands (``rounds`` times, with another each time), and only members that are then still in
different components are compared with each other. For these few documents a parity sketch discards pairs for certain: each shingle turns one bit of 2048,
so that two sketches differ in no more bits than the sets in shingles, and a link allows few of those.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.llm import blocks as B
from tarnwork.llm.bytesops import U64, Prefix, lower_ascii, mix, tokens, word_spans
from tarnwork.llm.common import cut
from tarnwork.llm.components import components
from tarnwork.llm.phrases import join_words

SHINGLE, BANDS, ROWS, BITS = 5, 48, 4, 2
LONGS = -(-BANDS * ROWS * BITS // 64)
#: Similarity is least[0] / least[1] or more.
LEAST = (75, 100)
MARGIN = 0.25
SKETCH = 2048


def words_of(b: B.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The text in lower case (A-Z), its words' starts and ends, and the documents' offsets into them."""
    flat = lower_ascii(b.flat)
    return flat, *word_spans(flat, b.offsets)


def made_of(count: np.ndarray) -> np.ndarray:
    """Number of shingles, repeated ones too, of texts of so many words: one at least if there is a word."""
    return np.where(count >= SHINGLE, count - SHINGLE + 1, (count > 0).astype(np.int64))


def shingles(flat: np.ndarray, start: np.ndarray, end: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each document's distinct shingles, ascending, the offsets into them, and the exact number of its distinct
    shingles, by words.

    A document of fewer than five words has its whole sequence as one.
    """
    number, hashes = tokens(flat, start, end)
    sums = Prefix(hashes[number])
    count = np.diff(cuts)
    made = made_of(count)
    doc = np.repeat(np.arange(len(count)), made)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(made) - made, made) + cuts[:-1][doc]
    h = sums.spans(first, np.minimum(first + SHINGLE, cuts[1:][doc]), 8)
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    h, doc, first = h[order], doc[order], first[order]
    other = np.zeros(0, np.int64)
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
        again = np.flatnonzero(~new)
        size = np.minimum(SHINGLE, count[doc[again]])
        same = np.ones(len(again), bool)
        for k in range(SHINGLE):
            at = np.where(k < size, k, 0)
            same &= number[first[again] + at] == number[first[again - 1] + at]
        other = np.unique(doc[again[~same]])
        h, doc = h[new], doc[new]
    at = np.searchsorted(doc, np.arange(len(count) + 1))
    n = np.diff(at)
    # different shingles of one hash in one document: count these by words
    for d in other.tolist():
        w = number[cuts[d] : cuts[d + 1]].tolist()
        n[d] = len({tuple(w[i : i + SHINGLE]) for i in range(max(len(w) - SHINGLE + 1, 1))})
    return h, at, n


def exact_shingles(number: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The document and the shingle's number of each distinct shingle, numbers being equal for equal words only."""
    count = np.diff(cuts)
    made = made_of(count)
    doc = np.repeat(np.arange(len(count)), made)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(made) - made, made) + cuts[:-1][doc]
    stop = np.minimum(first + SHINGLE, cuts[1:][doc])
    kind = np.zeros(len(doc), np.int64)
    for k in range(SHINGLE):
        word = np.where(first + k < stop, number[np.minimum(first + k, max(len(number) - 1, 0))] + 1, 0)
        kind = np.unique((kind << 32) | word, return_inverse=True)[1]
    both = np.unique((doc << 32) | kind)
    return both >> 32, both & 0xFFFFFFFF


def _odd(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(n, dtype=U64), seed) | U64(1)


def signatures(h: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (documents x bands) and packed low bits (documents x longs) of documents that have shingles."""
    start = cuts[:-1]
    low = np.empty((len(start), BANDS * ROWS), U64)
    for k, a in enumerate(_odd(BANDS * ROWS, 31)):
        low[:, k] = np.minimum.reduceat(h * a, start)
    keys = np.zeros((len(start), BANDS), U64)
    for r in range(ROWS):
        keys = mix(keys + mix(low[:, r::ROWS], 41 + r), 3)
    keys = mix(keys + np.arange(BANDS, dtype=U64), 5)
    bits = mix(low, 2) & U64((1 << BITS) - 1)
    lanes = 64 // BITS
    packed = np.zeros((len(start), LONGS), U64)
    for k in range(BANDS * ROWS):
        packed[:, k // lanes] |= bits[:, k] << U64(BITS * (k % lanes))
    return keys, packed


def sketches(h: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Packed parities of the numbers of shingles that fall on each bit."""
    n = len(cuts) - 1
    doc = np.repeat(np.arange(n), np.diff(cuts))
    bit = (mix(h, 71) % U64(SKETCH)).astype(np.int64)
    odd = np.bincount(doc * SKETCH + bit, minlength=n * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, SKETCH), axis=1, bitorder="little").view(U64)


_SIGNED = "block long, doc_id long, n_shingles long, content binary, bands array<long>, bits array<long>"


def _sign(number, b, _):
    flat, start, end, at = words_of(b)
    h, cuts, n = shingles(flat, start, end, at)
    some = np.flatnonzero(n)
    has = n > 0
    keys, bits = signatures(h, np.append(cuts[some], len(h))) if len(some) else (np.zeros((0, BANDS), U64), np.zeros((0, LONGS), U64))
    text = join_words(flat, start, end, at)
    edge, data = np.frombuffer(text.buffers()[1], np.int32), memoryview(text.buffers()[2])
    content = [hashlib.sha256(data[a:z]).digest() for a, z in zip(edge[:-1].tolist(), edge[1:].tolist())]

    def lists(x):
        at = np.concatenate([[0], np.cumsum(has * x.shape[1])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), pa.array(x.reshape(-1).view(np.int64)), mask=pa.array(~has))

    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(n), number)), b.id_array(), pa.array(n), pa.array(content, pa.binary()), lists(keys), lists(bits)], names=["block", "doc_id", "n_shingles", "content", "bands", "bits"]
    )


def _estimate(a: str, b: str):
    """Similarity by the packed low bits, less the share of chance collisions."""
    apart = F.lit(0)
    for k in range(LONGS):
        x = F.get(F.col(a), F.lit(k)).bitwiseXOR(F.get(F.col(b), F.lit(k)))
        apart = apart + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    chance = 1.0 / (1 << BITS)
    return (1 - apart / F.lit(float(BANDS * ROWS)) - chance) / (1 - chance)


def _near(a_bits: str, b_bits: str, a_n: str, b_n: str):
    p, q = LEAST
    sizes = F.least(a_n, b_n) * q >= F.greatest(a_n, b_n) * p
    return sizes & (_estimate(a_bits, b_bits) >= p / q - MARGIN)


def _may_link(a: str, b: str, a_n: str, b_n: str):
    """False only for pairs whose sets differ in more shingles than a link allows."""
    p, q = LEAST
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    # of sets that are similar to p / q, a share (q - p) / (q + p) of both sizes at most differs
    return differ * (p + q) <= (F.col(a_n) + F.col(b_n)) * (q - p)


def describe(packed: DataFrame, wanted: DataFrame, of, schema: str) -> DataFrame:
    """(id, what ``of(text, starts, ends, offsets)`` tells of each document) for the distinct (block, id) wanted."""
    ids = wanted.distinct().groupBy("block").agg(F.sort_array(F.collect_list("id")).alias("ids"))

    def tell(it):
        for batch in it:
            for i in range(batch.num_rows):
                b = B.Block.load(batch.column("head")[i].as_py(), batch.column("text")[i].as_py())
                mine = np.flatnonzero(np.isin(b.ids, np.array(batch.column("ids")[i].as_py(), np.int64)))
                if not len(mine):
                    continue
                take = np.concatenate([np.arange(b.offsets[k], b.offsets[k + 1]) for k in mine])
                part = B.Block(b.flat[take], np.concatenate([[0], np.cumsum(np.diff(b.offsets)[mine])]), b.ids[mine])
                flat, start, end, cuts = words_of(part)
                full = np.diff(cuts) > 0
                told = of(flat, start, end, np.append(cuts[:-1][full], len(start)))
                yield pa.RecordBatch.from_arrays([pa.array(part.ids[full]), told], names=["id", "told"])

    return cut(packed.join(ids, "block").mapInArrow(tell, f"id long, told {schema}"))


def _words(flat, start, end, cuts) -> pa.Array:
    """The documents' words, each joined and packed."""
    text = join_words(flat, start, end, cuts)
    edge, data = np.frombuffer(text.buffers()[1], np.int32), memoryview(text.buffers()[2])
    return pa.array([B.squeeze(data[a:z]) for a, z in zip(edge[:-1].tolist(), edge[1:].tolist())], pa.binary())


def _sketch(flat, start, end, cuts) -> pa.Array:
    bits = sketches(*shingles(flat, start, end, cuts)[:2])
    at = np.arange(len(bits) + 1, dtype=np.int32) * bits.shape[1]
    return pa.ListArray.from_arrays(pa.array(at), pa.array(bits.reshape(-1).view(np.int64)))


def _similar(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Whether the documents of each pair, given by their words, are similar enough."""
    texts = [B.unsqueeze(x) for pair in zip(left, right) for x in pair]
    flat = np.frombuffer(b"".join(texts), np.uint8)
    start, end, cuts = word_spans(flat, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    doc, kind = exact_shingles(tokens(flat, start, end)[0], cuts)
    size = np.bincount(doc, minlength=len(texts)).reshape(-1, 2).sum(axis=1)
    _, many = np.unique((doc >> 1 << 32) | kind, return_counts=True)
    pair = np.unique((doc >> 1 << 32) | kind)[many == 2] >> 32
    both = np.bincount(pair, minlength=len(left))
    p, q = LEAST
    return q * both >= p * (size - both)


#: Pairs that are compared at once.
_PAIRS = 200


def confirm(packed: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (u, v, u_block, v_block) whose full sets, by their words, are similar enough."""
    wanted = pairs.select(F.col("u_block").alias("block"), F.col("u").alias("id")).unionByName(pairs.select(F.col("v_block").alias("block"), F.col("v").alias("id")))
    have = describe(packed, wanted, _words, "binary").withColumnRenamed("told", "words")

    def compare(it):
        for batch in it:
            for lo in range(0, batch.num_rows, _PAIRS):
                part = batch.slice(lo, _PAIRS)
                ok = _similar(part.column("x").to_pylist(), part.column("y").to_pylist())
                yield part.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    joined = pairs.select("u", "v").join(have.select(F.col("id").alias("u"), F.col("words").alias("x")), "u").join(have.select(F.col("id").alias("v"), F.col("words").alias("y")), "v")
    return joined.select("u", "v", "x", "y").mapInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, block_bytes: int = B.BLOCK, rounds: int = 1) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links) and kept (doc_id = component_id).

    Documents without words have no shingles and no links. Rows that repeat a doc_id are one document
    with several texts. Rows without doc_id are linked with nothing: component_id is null, kept false.
    An empty table gives an empty result.
    """
    packed = B.pack(docs, block_bytes)
    signed = cut(B.each_block(packed, _sign, 0, _SIGNED))
    live = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # one node for all equal sequences of words: their least doc_id
    first = F.min_by(F.struct("doc_id", "block", "n_shingles", "bands", "bits"), F.col("doc_id")).alias("first")
    nodes = cut(live.groupBy("content").agg(first).select("content", "first.*"))
    copies = live.select("doc_id", "content").join(nodes.select("content", F.col("doc_id").alias("v")), "content").select(F.col("doc_id").alias("u"), "v")
    banded = nodes.select(F.posexplode("bands").alias("band", "key"), F.col("doc_id").alias("u"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    banded = cut(banded.join(shared, "key"))
    # who meets most others in all bands is most likely what the others were made from
    central = banded.groupBy("u").agg(F.sum("many").alias("u_met"))
    banded = banded.drop("many")
    facts = nodes.select(F.col("doc_id").alias("u"), F.col("block").alias("u_block"), F.col("n_shingles").alias("u_n"), F.col("bits").alias("u_bits"))
    facts = cut(facts.join(central, "u"))
    near = _near("u_bits", "v_bits", "u_n", "v_n")
    as_v = [F.col(f"u{x}").alias(f"v{x}") for x in ("", "_block", "_n", "_bits")]
    links, roots = cut(copies.filter("u != v")), None
    for turn in range(rounds + 1):
        members = banded
        if roots is not None:
            members = banded.join(roots.withColumnRenamed("node", "u"), "u", "left").withColumn("root", F.coalesce("root", "u"))
            mixed = members.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).filter("_a != _b").select("key")
            members = members.join(mixed, "key")
        else:
            members = members.withColumn("root", F.col("u"))
        members = cut(members).join(facts, "u")
        if turn < rounds:
            order = F.xxhash64("u", F.lit(turn)) if turn else F.struct(-F.col("u_met"), F.col("u"))
            lead = members.groupBy("key").agg(F.min_by(F.struct(*as_v, F.col("root").alias("v_root")), order).alias("lead")).select("key", "lead.*")
            pairs = members.join(lead, "key").filter((F.col("root") != F.col("v_root")) & near)
        else:
            finer = describe(packed, members.select(F.col("u_block").alias("block"), F.col("u").alias("id")), _sketch, "array<long>")
            finer = finer.join(nodes.select(F.col("doc_id").alias("id"), "bands"), "id").select(F.col("id").alias("u"), F.col("told").alias("u_sketch"), F.col("bands").alias("u_bands"))
            members = members.join(finer, "u")
            other = members.select(F.col("key").alias("v_key"), *as_v, F.col("root").alias("v_root"), F.col("u_sketch").alias("v_sketch"), F.col("u_bands").alias("v_bands"))
            first_band = F.array_position(F.zip_with("u_bands", "v_bands", lambda x, y: x == y), F.lit(True)) == F.col("band") + 1
            pairs = members.join(other, (F.col("key") == F.col("v_key")) & (F.col("root") < F.col("v_root")) & near & first_band & _may_link("u_sketch", "v_sketch", "u_n", "v_n"))
        pairs = cut(pairs.select("u", "u_block", "v", "v_block").distinct())
        roots = components(links.unionByName(confirm(packed, pairs)))
        # the stars stand for all links so far
        links = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
    out = signed.select("doc_id", "n_shingles").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, without all but one document of each class.

    Rows without doc_id stay. Of rows that repeat a kept doc_id, the one with the least text hash stays.
    Empty and null texts are classes of their own and stay.
    """
    kept = near_duplicates(docs).filter("kept").select("doc_id").distinct()
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("row")
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), F.xxhash64("text").alias("order"), row)
    named = [F.col("row")[c].alias(c) for c in docs.columns]
    # one row of each doc_id, chosen before and after the shuffle
    one = rows.filter("key IS NOT NULL").groupBy("key").agg(F.min_by("row", "order").alias("row"))
    one = one.join(kept, F.col("key") == F.col("doc_id"), "left_semi")
    return one.select(*named).unionByName(rows.filter("key IS NULL").select(*named))


#: Exact links, without banding: for tables whose shared shingles DuckDB can hold.
SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS u, y.doc_id AS v, count(*) AS m FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM b JOIN n p ON u = p.doc_id JOIN n q ON v = q.doc_id WHERE 100 * m >= 75 * (p.n + q.n - m)),
r AS (SELECT doc_id AS node, doc_id AS root FROM d),
c AS (WITH RECURSIVE t(node, root) USING KEY (node) AS (SELECT node, root FROM r UNION SELECT l.v, min(t.root) FROM t JOIN l ON l.u = t.node JOIN recurring.t o ON o.node = l.v WHERE t.root < o.root GROUP BY l.v) SELECT * FROM t)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.root AS component_id, c.root = d.doc_id AS kept FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON c.node = d.doc_id
"""
