"""Removal of byte strings that also occur in an earlier document, by merged suffix order.

All suffixes of a corpus are beyond any disk budget, so one stands for the windows of a segment (see
``repeats``): the suffix that begins at the segment's anchor, as far as its windows reach, and after it
the bytes before the anchor, backwards. Each block sorts its suffixes by their bytes and sends
front-coded runs; a bucket merges the runs by a loser tree that never compares a known prefix again.
As in a suffix array, suffixes with a common prefix of some length are neighbours, and the common
prefix lengths tell where their groups end. Two windows of ``n`` bytes, ``j`` of them before the anchor,
are equal if their suffixes share ``n - j`` bytes and the bytes before share ``j``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.llm import blocks as B
from tarnwork.llm import repeats as R
from tarnwork.llm.bytesops import U64, byte_grams, cover, runs
from tarnwork.llm.losertree import merge


def common_bytes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Equal leading bytes of numbers that hold eight bytes, the first one highest."""
    differ = x ^ y
    out = np.zeros(len(x), np.int64)
    for k in range(8):
        out += (differ >> U64(56 - 8 * k)) == 0
    return out


class Suffixes:
    """Suffixes as symbols of eight bytes: from the anchor on, then backwards before it, then both lengths."""

    per_byte, segments = 1.0, 100_000

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.ahead, self.behind = -(-n // 8), -(-(n - k) // 8)

    def windows(self, b: B.Block) -> R.Windows:
        w = R.Windows(byte_grams(b.flat, self.k), b.offsets, b.ids, self.n, self.k)
        w.flat = b.flat
        return w

    def rows(self, w: R.Windows, which: np.ndarray) -> np.ndarray:
        place = w.place[which]
        after, before = w.last[which] + self.n - place, place - w.first[which]
        parts = []
        for length, width, step in ((after, self.ahead, 1), (before, self.behind, -1)):
            at = np.arange(8 * width)
            spot = np.clip(place[:, None] + (at if step > 0 else -1 - at), 0, max(len(w.flat) - 1, 0))
            chars = np.where(at < length[:, None], w.flat[spot], 0).astype(np.uint8)
            parts.append(chars.reshape(len(which), width, 8).view(">u8")[:, :, 0].astype(U64))
        return np.concatenate([*parts, (after * 65536 + before).astype(U64)[:, None]], axis=1)

    def order(self, rows: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return np.lexsort((*rows.T[::-1], bucket))

    def runs(self, w, which, rows, owner, start, stop) -> list[bytes]:
        """Front-coded: the number of leading symbols that each suffix shares with the one before, and the rest."""
        differ = np.ones(rows.shape, bool)
        differ[1:] = rows[1:] != rows[:-1]
        shared = np.where(differ.any(axis=1), np.argmax(differ, axis=1), rows.shape[1])
        shared[start] = 0
        own = shared[:, None] <= np.arange(rows.shape[1])
        tails, upto = rows[own].astype(">u8"), np.concatenate([[0], np.cumsum(own.sum(axis=1))])
        return [B.put_ints((shared[a:z], False), (owner[a:z].view(U64), False), tail=tails[upto[a] : upto[z]].tobytes()) for a, z in zip(start.tolist(), stop.tolist())]

    def combine(self, parts: list[bytes]):
        got = [B.get_ints(part, tail=True) for part in parts]
        sizes = [len(g[0]) for g in got]
        shared, owner = np.concatenate([g[0] for g in got]).astype(np.int64), np.concatenate([g[1] for g in got]).view(np.int64)
        depth = self.ahead + self.behind + 1
        symbols = np.empty((len(shared), depth), U64)
        own = shared[:, None] <= np.arange(depth)
        symbols[own] = np.frombuffer(b"".join(g[2] for g in got), ">u8")
        # a run's first suffix shares nothing, so what is shared is in the same run
        last = np.maximum.accumulate(np.where(own, np.arange(len(shared))[:, None], 0), axis=0)
        symbols = np.ascontiguousarray(np.take_along_axis(symbols, last, axis=0).T)
        base = np.concatenate([[0], np.cumsum(sizes)])
        pairs = list(zip(base[:-1].tolist(), base[1:].tolist()))
        columns, commons = [x.tolist() for x in symbols], shared.tolist()
        run, at, common = (np.array(x, np.int64) for x in merge([[c[a:z] for c in columns] for a, z in pairs], [commons[a:z] for a, z in pairs]))
        order = base[run] + at
        entry, t = self.resolve(symbols[:, order], owner[order], common)
        return sizes, order[entry], t

    def resolve(self, symbols: np.ndarray, owner: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Late windows (suffix, place in its segment) of suffixes in merged order, given the symbols that each shares
        with the one before it."""
        at = np.arange(1, len(owner))
        depth = np.minimum(common[1:], self.ahead - 1)
        share = 8 * depth + common_bytes(symbols[depth, at], symbols[depth, at - 1])
        # only suffixes that share their anchor with a neighbour can have equal windows
        near = np.concatenate([[False], share >= self.k, [False]])
        some = np.flatnonzero(near[1:] | near[:-1])
        if not len(some):
            return some, some
        share = np.concatenate([[0], share])[some]
        symbols, owner = symbols[:, some], owner[some]
        most, least = (symbols[-1] & U64(65535)).astype(np.int64), self.n - (symbols[-1] >> U64(16)).astype(np.int64)
        # the bytes before the anchors in their own order, with the lengths that neighbours share
        back = symbols[self.ahead : -1]
        by = np.lexsort(back[::-1])
        same = np.zeros(len(by), np.int64)
        going = np.ones(len(by) - 1, bool)
        for x in back:
            c = common_bytes(x[by[1:]], x[by[:-1]])
            same[1:] += np.where(going, c, 0)
            going &= c == 8
        entries, places = [], []
        for j in range(self.n - self.k + 1):
            has = np.flatnonzero((least <= j) & (j <= most))
            if len(has) < 2:
                continue
            ahead = np.cumsum(share < self.n - j)
            behind = np.empty(len(by), np.int64)
            behind[by] = np.cumsum(same < j)
            late = has[R.late_of((ahead[has] << 32) | behind[has], owner[has])]
            entries.append(some[late]), places.append(most[late] - j)
        return np.concatenate(entries or [some[:0]]), np.concatenate(places or [some[:0]])


def remove_repeats(docs: DataFrame, n: int = 50, k: int = 24, block_bytes: int = B.BLOCK) -> DataFrame:
    """Removes each byte covered by an ``n``-byte string that also starts in a document of smaller doc_id.

    Returns doc_id, n_bytes, spans (array of struct start, end: the maximal removed runs) and kept
    (binary). Null text is empty; texts under ``n`` bytes are kept whole; rows that repeat a doc_id
    are documents of equal rank, so neither is earlier; a null doc_id ranks last; strings never cross
    documents; an empty table gives an empty result. ``k`` is eight or more; other columns, of any
    name, don't matter.
    """
    found, plan = R.find(docs, Suffixes(n, k), block_bytes)

    def remove(number, b, notes):
        gone = cover(len(b.flat), *R.Entries(plan, b, notes[0]).late(notes[1]))
        lo, hi, cuts = runs(gone, b.offsets)
        first = np.repeat(b.offsets[:-1], np.diff(cuts))
        spans = pa.StructArray.from_arrays([pa.array(lo - first), pa.array(hi - first)], names=["start", "end"])
        kept = np.concatenate([[0], np.cumsum(~gone)])[b.offsets]
        data = pa.BinaryArray.from_buffers(pa.binary(), len(b.ids), [None, pa.py_buffer(kept.astype(np.int32)), pa.py_buffer(b.flat[~gone].tobytes())])
        yield pa.RecordBatch.from_arrays(
            [b.id_array(), pa.array(np.diff(b.offsets)), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), spans), data], names=["doc_id", "n_bytes", "spans", "kept"]
        )

    return B.each_block(found, remove, 2, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def digest(removed: DataFrame) -> DataFrame:
    """Sizes and hash of what ``remove_repeats`` kept; one row a document, nulls and empty texts too."""
    return removed.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 49, 0))) AS i FROM d)),
m AS (SELECT s, min(doc_id) AS first_id FROM w GROUP BY s HAVING count(*) > 1),
late AS (SELECT doc_id, i FROM w JOIN m USING (s) WHERE first_id < doc_id),
g AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i, unnest(range(0, 50)) AS j FROM late)),
r AS (SELECT doc_id, min(p) AS a, max(p) + 1 AS z FROM (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k FROM g) GROUP BY doc_id, k),
x AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM r),
k AS (SELECT x.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept, sum(z - a) AS n, count(*) AS spans FROM x JOIN d ON x.doc_id = d.doc_id GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
