"""Benchmark passages in documents, by Wu-Manber search.

Texts are words joined by one space (see ``words``), with a space before and after, so that strings meet
words at their edges only. The test strings are the windows of an item's words. A cursor looks at the last
block of bytes of the window it stands on: a table of shifts tells how far it may move without missing a
string. Where the shift is nought, the block and the string's first bytes choose a bucket of test strings,
and these are compared with the text byte by byte. Many cursors move at once, each over its own lane.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.llm import blocks as B
from tarnwork.llm.bytesops import U64, arrow_bytes, cover, eights, give_back, member, mix, pieces, span_hash, tokens
from tarnwork.llm.common import cut, documents
from tarnwork.llm.words import Words

WINDOW = 10
#: Bytes of a cursor's lane.
LANE = 1024
#: Pairs of a place and a test string that are compared at a time.
PAIRS = 200_000
#: Lengths from which on strings are searched apart: short ones would shorten the shifts of all.
CLASSES = (0, 8, 16)
#: Words of an item that are sent in one row; longer items are sent in parts that overlap.
PART_WORDS = 50_000


def spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of ``count`` entries each: the range of every entry, and its place there."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)


def _mask(size: int) -> np.uint64:
    return U64(2**64 - 1) >> U64(64 - 8 * size)


def same_bytes(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether spans of equal size are equal; ``a`` and ``b`` come as ``eights``."""
    which, nth = spread((size + 7) >> 3)
    left = np.minimum(size[which] - 8 * nth, 8).astype(U64)
    off = (a[a_at[which] + 8 * nth] ^ b[b_at[which] + 8 * nth]) & (U64(2**64 - 1) >> (U64(64) - U64(8) * left))
    out = np.ones(len(size), bool)
    out[which[off != 0]] = False
    return out


class Search:
    """Shift table and buckets of test strings of like length."""

    def __init__(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray, number: np.ndarray):
        self.least = m = int(min(size.min(), 255))
        self.width = b = min(8, max(2, m // 2))
        see = eights(flat)
        self.bits = int(np.clip(np.ceil(np.log2(8 * len(start) + 1)) + 4, 12, 24))
        # shifts by falling size: the least that a block allows stays
        self.shift = np.full(1 << self.bits, m - b + 1, np.uint8)
        for s in range(m - b, -1, -1):
            self.shift[self._slot(see[start + (m - b - s)])] = s
        key = self._bucket(see, start)
        self.keys, of = np.unique(key, return_inverse=True)
        # the lengths of each bucket's strings
        pairs = np.unique(np.stack([of, size]), axis=1)
        self.sizes = pairs[1]
        self.cuts = np.searchsorted(pairs[0], np.arange(len(self.keys) + 1))
        hashed = span_hash(flat, start, start + size, 5)
        order = np.argsort(hashed, kind="stable")
        self.hashed, self.start, self.size, self.number = hashed[order], start[order], size[order], number[order]
        self.flat = flat

    def _slot(self, block: np.ndarray) -> np.ndarray:
        return (((block & _mask(self.width)) * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def _bucket(self, see: np.ndarray, at: np.ndarray) -> np.ndarray:
        m, b = self.least, self.width
        return mix(see[at + (m - b)] & _mask(b), 1) + mix(see[at] & _mask(min(8, m)), 2)

    def _candidates(self, see: np.ndarray, n: int) -> np.ndarray:
        """Places where the shift is nought."""
        last = n - self.least
        if last < 0:
            return np.zeros(0, np.int64)
        at = np.arange(0, last + 1, LANE)
        stop = np.minimum(at + LANE, last + 1)
        back = self.least - self.width
        found = []
        while len(at):
            step = self.shift[self._slot(see[at + back])].astype(np.int64)
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            go = at < stop
            at, stop = at[go], stop[go]
        return np.concatenate(found)

    def find(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, string's number) of every occurrence."""
        see, strings = eights(text), eights(self.flat)
        at = self._candidates(see, len(text))
        bucket = member(self._bucket(see, at), self.keys) if len(at) else at
        at, bucket = at[bucket >= 0], bucket[bucket >= 0]
        many = self.cuts[bucket + 1] - self.cuts[bucket]
        out = []
        for lo, hi in _chunks(many):
            which, nth = spread(many[lo:hi])
            place, size = at[lo:hi][which], self.sizes[self.cuts[bucket[lo:hi]][which] + nth]
            place, size = place[place + size <= len(text)], size[place + size <= len(text)]
            hashed = span_hash(text, place, place + size, 5)
            left = np.searchsorted(self.hashed, hashed)
            same = np.searchsorted(self.hashed, hashed, side="right") - left
            which, nth = spread(same)
            string = left[which] + nth
            alike = self.size[string] == size[which]
            which, string = which[alike], string[alike]
            yes = same_bytes(see, place[which], strings, self.start[string], self.size[string])
            out.append((place[which[yes]], self.number[string[yes]]))
        return tuple(np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in (0, 1))


def _chunks(many: np.ndarray):
    """Ranges of entries with about ``PAIRS`` in all each."""
    total = np.concatenate([[0], np.cumsum(many)])
    lo = 0
    while lo < len(many):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PAIRS, side="right")) - 1)
        yield lo, hi
        lo = hi


class Passages:
    """The distinct windows of some items, with the items that hold each."""

    def __init__(self, texts: pa.Array, items: list[str | None], window: int = WINDOW):
        w = Words(*arrow_bytes(texts))
        count = w.counts()
        first, last, of = w.grams(window)
        short = np.flatnonzero((count > 0) & (count < window))
        first, last, of = np.concatenate([first, w.cuts[short]]), np.concatenate([last, w.cuts[short + 1] - 1]), np.concatenate([of, short])
        # with the space before and after
        start, end = w.first[first] - 1, w.stop[last] + 1
        number, _ = tokens(w.text, start, end)
        _, one = np.unique(number, return_index=True)
        self.n_words = (last - first + 1)[one]
        named = sorted({i for i in items if i is not None})
        rank = {x: k for k, x in enumerate(named)}
        self.items = named
        item = np.array([-1 if i is None else rank[i] for i in items], np.int64)[of] if len(of) else of
        pairs = np.unique(np.stack([number[item >= 0], item[item >= 0]]), axis=1)
        self.holders, self.cuts = pairs[1], np.searchsorted(pairs[0], np.arange(len(one) + 1))
        start, size = start[one], (end - start)[one]
        self.searches = []
        edges = [*CLASSES, 2**62]
        for lo, hi in zip(edges, edges[1:]):
            if len(some := np.flatnonzero((size >= lo) & (size < hi))):
                self.searches.append(Search(w.text, start[some], size[some], some))

    def scan(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, last word's end and string's number of every occurrence in the documents."""
        found = [s.find(w.text) for s in self.searches]
        place, number = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        word = np.searchsorted(w.first, place + 1)
        return word, word + self.n_words[number], number

    def items_of(self, doc: np.ndarray, number: np.ndarray, n: int) -> pa.Array:
        """The items of each of ``n`` documents' occurrences, each once."""
        seen = np.unique(doc * (len(self.n_words) + 1) + number)
        doc, number = seen // (len(self.n_words) + 1), seen % (len(self.n_words) + 1)
        which, nth = spread(self.cuts[number + 1] - self.cuts[number])
        pairs = np.unique(doc[which] * (len(self.items) + 1) + self.holders[self.cuts[number][which] + nth])
        doc, item = pairs // (len(self.items) + 1), pairs % (len(self.items) + 1)
        values = pa.array(self.items, pa.string()).take(pa.array(item))
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), values)


def item_parts(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, text) of items' words; long items in parts that share ``window - 1`` words, so that each window is in one."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")

    def part(it):
        for batch in it:
            flat, offsets = arrow_bytes(batch.column("text"))
            for lo, hi in pieces(offsets):
                w = Words(flat[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                many = -(-np.maximum(w.counts() - window + 1, np.minimum(w.counts(), 1)) // PART_WORDS)
                of, nth = spread(many)
                first = w.cuts[of] + nth * PART_WORDS
                last = np.minimum(first + PART_WORDS + window - 1, w.cuts[of + 1]) - 1
                texts = [w.text[a:z].tobytes().decode(errors="replace") for a, z in zip(w.first[first].tolist(), w.stop[last].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(lo + of)), pa.array(texts, pa.string())], names=["item_id", "text"])

    return items.mapInArrow(part, "item_id string, text string")


def passages_in(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = 4_000_000) -> DataFrame:
    """The words of each document that lie in a passage of a benchmark item, and the items.

    A passage is ``window`` consecutive words of an item, or a shorter item's words. Returns doc_id, n_words,
    n_hit, items (item_ids as strings, each once, sorted). Words are cut at ASCII characters other than digits and
    letters; A-Z are lowered. A null or empty document has no words and no items; an item without words is
    nowhere; items of one item_id are one; one without item_id hits words but isn't listed. Rows that repeat a
    doc_id are documents of their own; an empty table on either side gives no hits; other columns don't matter.

    The items are sent to the executors in shards of about ``shard_bytes``, and the documents are read once for each:
    once for a benchmark of up to that size, without a shuffle.
    """
    rows = documents(docs)
    parts = cut(item_parts(benchmark, window))
    total = parts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_bytes))
    context = docs.sparkSession.sparkContext

    def sent(k: int):
        some = parts if shards == 1 else parts.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k)
        table = some.toArrow()
        return context.broadcast(Passages(table.column("text").combine_chunks(), table.column("item_id").to_pylist(), window))

    if shards == 1:
        return _digested(rows, sent(0))
    # each document keeps its place in its block, and each shard says what it found there
    packed = B.pack(docs)
    base = B.each_block(packed, _sizes, 0, "block long, nth long, doc_id long, n_words long")
    found = None
    for k in range(shards):
        some = B.each_block(packed, _hits(sent(k)), 0, "block long, nth long, start long, end long, items array<string>")
        found = some if found is None else found.unionByName(some)
    # spans by start: what a span adds lies beyond the furthest end before it
    keys = ["block", "nth"]
    spans = found.filter("start IS NOT NULL").groupBy(*keys, "start").agg(F.max("end").alias("end"))
    spans = spans.withColumn("spans", F.struct("start", "end")).groupBy(*keys).agg(F.sort_array(F.collect_list("spans")).alias("spans"))
    spans = spans.withColumn("n_hit", F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")), _add, lambda a: a.n)).drop("spans")
    listed = found.select(*keys, F.explode("items").alias("item")).distinct().groupBy(*keys).agg(F.sort_array(F.collect_list("item")).alias("items"))
    out = base.join(spans, keys, "left").join(listed, keys, "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _add(a, x):
    return F.struct((a.n + F.greatest(x.end - F.greatest(x.start, a.to), F.lit(0))).alias("n"), F.greatest(a.to, x.end).alias("to"))


def _digested(rows: DataFrame, sent) -> DataFrame:
    def scan(it):
        passages = sent.value
        for batch in it:
            flat, offsets = arrow_bytes(batch.column("text"))
            for lo, hi in pieces(offsets):
                w = Words(flat[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                start, end, number = passages.scan(w)
                hit = np.concatenate([[0], np.cumsum(cover(len(w.first), start, end))])[w.cuts]
                doc = np.searchsorted(w.cuts, start, side="right") - 1
                columns = [batch.column("doc_id").slice(lo, hi - lo), pa.array(w.counts()), pa.array(np.diff(hit)), passages.items_of(doc, number, hi - lo)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_hit", "items"])
            give_back()

    return rows.mapInArrow(scan, "doc_id long, n_words long, n_hit long, items array<string>").withColumn("items", F.array_sort("items"))


def _sizes(block, b, _):
    n = len(b.ids)
    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(np.arange(n)), b.id_array(), pa.array(Words(b.flat, b.offsets).counts())], names=["block", "nth", "doc_id", "n_words"])


def _hits(sent):
    def hits(block, b, _):
        passages = sent.value
        w = Words(b.flat, b.offsets)
        start, end, number = passages.scan(w)
        doc = np.searchsorted(w.cuts, start, side="right") - 1
        spans = np.unique(np.stack([doc, start - w.cuts[doc], end - w.cuts[doc]]), axis=1)
        some = np.unique(doc)
        items = passages.items_of(np.searchsorted(some, doc), number, len(some))
        n, m = spans.shape[1], len(some)
        none = pa.nulls(m, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n + m, block)), pa.array(np.concatenate([spans[0], some])), *(pa.concat_arrays([pa.array(spans[k]), none]) for k in (1, 2)), pa.concat_arrays([pa.nulls(n, items.type), items])],
            names=["block", "nth", "start", "end", "items"],
        )

    return hits


def digest(found: DataFrame) -> DataFrame:
    """Counts and hash of what ``passages_in`` found."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
      FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
l AS (SELECT DISTINCT n FROM p),
g AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
      FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d, l)),
o AS (SELECT doc_id, g.n, i, item_id FROM g JOIN p ON g.n = p.n AND g.s = p.s),
h AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, n)) AS j FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM o) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
