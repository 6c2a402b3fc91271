"""Windows of symbols that also occur in an earlier document, found exactly over the whole corpus.

A document is a sequence of symbols (bytes, words or lines). Every window of ``n`` symbols is filed
under its first least ``k``-gram by hash (winnowing), its anchor, which windows of equal content share
at the same place wherever they stand. Consecutive windows with one anchor make a segment.

1. Anchors that occur in one document only are dropped.
2. The segments under the other anchors are sent, as text, to the anchors' buckets, each block's equal
   ones once with the least of its documents that hold them. As equal windows have equal anchors, they
   all meet in one bucket, which compares content and tells each block which windows an earlier
   document holds.

Hashes only say where segments meet; a chance collision costs work and changes nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarnwork.llm import blocks as B
from tarnwork.llm.bytesops import U64, Prefix, member, mix, sliding_min, tokens
from tarnwork.llm.common import cut, partitions

#: The share of all segments that are expected to recur.
SHARE = 0.3


class Windows:
    """The valid windows of a block: their segments, and each one's anchor (hash, place) and owner."""

    def __init__(self, grams: np.ndarray, cuts: np.ndarray, ids: np.ndarray, n: int, k: int):
        self.n, self.cuts, self.ids = n, cuts, ids
        total = int(cuts[-1])
        # the least hash, and of equal ones the first, which equal windows choose alike
        place = (grams >> U64(32) << U64(32)) | np.arange(len(grams), dtype=U64)
        place = (sliding_min(place, n - k + 1) & U64(0xFFFFFFFF)).astype(np.int64)
        sizes = np.diff(cuts)
        doc = np.repeat(np.arange(len(ids)), sizes)
        many = sizes >= n
        starts, ends = cuts[:-1][many], cuts[1:][many] - n + 1
        depth = np.bincount(starts, minlength=total + 1) - np.bincount(ends, minlength=total + 1)
        valid = np.cumsum(depth)[: len(place)] > 0
        change = np.ones(len(place), bool)
        if len(place):
            change[1:] = (place[1:] != place[:-1]) | (doc[1 : len(place)] != doc[: len(place) - 1])
        first = np.flatnonzero(change & valid)
        # a segment ends where the next one begins or the document's windows end
        stop = np.append(first[1:], total)
        self.first, self.doc = first, doc[first]
        self.last = np.minimum(stop, cuts[self.doc + 1] - n + 1) - 1
        self.place = place[first]
        self.anchor = grams[self.place] if len(first) else np.zeros(0, U64)
        self.owner = ids[self.doc]


class Sequences:
    """Segments of words or lines, about ``segments`` of them in a bucket. ``read(b)`` gives the block's tokens: start, end, documents' offsets, and which
    of them are a second symbol of the token before (null: none)."""

    segments = 60_000

    def __init__(self, read, resolve, n: int, k: int, per_byte: float):
        self.read, self.resolve, self.n, self.k, self.per_byte = read, resolve, n, k, per_byte

    def windows(self, b: B.Block) -> Windows:
        start, end, cuts, second = self.read(b)
        number, hashes = tokens(b.flat, start, end)
        hashes = hashes[number]
        w = Windows(self.grams(hashes, second), cuts, b.ids, self.n, self.k)
        w.flat, w.start, w.end, w.second = b.flat, start, end, second
        w.number = number if second is None else number * 2 + second
        return w

    def grams(self, hashes: np.ndarray, second: np.ndarray | None) -> np.ndarray:
        if second is not None:
            hashes = np.where(second, mix(hashes, 12), hashes)
        return mix(hashes, 1) if self.k == 1 else Prefix(hashes).grams(self.k)

    def rows(self, w: Windows, which: np.ndarray) -> np.ndarray:
        """The segments' content in a row each, by the block's own numbers."""
        size = w.last[which] - w.first[which] + self.n
        at = np.arange(2 * self.n - self.k)
        spot = np.minimum(w.first[which][:, None] + at, max(len(w.number) - 1, 0))
        return np.where(at < size[:, None], w.number[spot], -1)

    def order(self, rows: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return np.argsort(bucket, kind="stable")

    def runs(self, w: Windows, which: np.ndarray, rows: np.ndarray, owner: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[bytes]:
        count = w.last[which] - w.first[which] + 1
        size = count + self.n - 1
        token = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(w.first[which], size)
        # the tokens' text, a line feed after each, which no token holds
        length = w.end[token] - w.start[token]
        ends = np.cumsum(length + 1)
        text = np.full(int(ends[-1]) if len(ends) else 0, 0x0A, np.uint8)
        spot = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        text[spot + np.repeat(ends - length - 1, length)] = w.flat[spot + np.repeat(w.start[token], length)]
        second = np.zeros(len(token), bool) if w.second is None else w.second[token]
        ends, upto = np.concatenate([[0], ends]), np.concatenate([[0], np.cumsum(size)])
        out = []
        for a, z in zip(start.tolist(), stop.tolist()):
            s, t = upto[a], upto[z]
            out.append(B.put_ints((count[a:z], False), (owner[a:z].view(U64), False), (second[s:t], False), tail=text[ends[s] : ends[t]].tobytes()))
        return out

    def combine(self, runs: list[bytes]):
        """(entries of each run, late windows' entries and places) of a bucket."""
        count, owner, second, texts = [], [], [], []
        for r in runs:
            c, o, s, text = B.get_ints(r, tail=True)
            count.append(c.astype(np.int64)), owner.append(o.view(np.int64)), second.append(s > 0), texts.append(text)
        sizes = [len(c) for c in count]
        count, owner, second = np.concatenate(count), np.concatenate(owner), np.concatenate(second)
        flat = np.frombuffer(b"".join(texts), np.uint8)
        end = np.flatnonzero(flat == 0x0A)
        number, hashes = tokens(flat, np.concatenate([[0], end[:-1] + 1]) if len(end) else end, end)
        # an entry's windows have one anchor, which is the least gram of the first
        begin = np.cumsum(count + self.n - 1) - (count + self.n - 1)
        grams = self.grams(hashes[number], second) >> U64(32)
        shard = np.min(grams[begin[:, None] + np.arange(self.n - self.k + 1)], axis=1) if len(begin) else begin.astype(U64)
        return sizes, *self.resolve(number * 2 + second, count, owner, self.n, shard)


def by_pairs(number: np.ndarray, count: np.ndarray, owner: np.ndarray, n: int, _) -> tuple[np.ndarray, np.ndarray]:
    """Windows of two symbols that an earlier owner holds too."""
    size = count + 1
    entry = np.repeat(np.arange(len(count)), count)
    t = np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count)
    at = (np.cumsum(size) - size)[entry] + t
    late = late_of((number[at] << 32) | number[at + 1], owner[entry])
    return entry[late], t[late]


def late_of(key: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Mask of the rows whose key an earlier owner has too."""
    if not len(key):
        return np.zeros(0, bool)
    order = np.argsort(key, kind="stable")
    k, o = key[order], owner[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    out = np.empty(len(key), bool)
    out[order] = np.repeat(np.minimum.reduceat(o, at), np.diff(np.append(at, len(k)))) < o
    return out


def least_owner(key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with their least owner and whether they have several."""
    if not len(key):
        return key, owner, np.zeros(0, bool)
    order = np.argsort(key, kind="stable")
    k, o = key[order], owner[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    low, high = np.minimum.reduceat(o, at), np.maximum.reduceat(o, at)
    return k[at], low, low != high


class Plan:
    """What is searched, and the widths that its size calls for."""

    def __init__(self, kind, size: int, parts: int):
        self.kind = kind
        anchors = size * kind.per_byte * 2 / (kind.n - kind.k + 2)
        least = int(np.ceil(np.log2(2 * parts)))
        self.bits = max(least, B.bucket_bits(anchors))
        self.segment_bits = max(least, B.bucket_bits(anchors * SHARE, kind.segments))
        self.drop = 64 - min(64, max(32, int(np.ceil(np.log2(max(2.0, anchors)))) + 14))


class Entries:
    """A block's distinct segments under recurring anchors, by bucket: each one's least owner and all its places."""

    def __init__(self, plan: Plan, b: B.Block, notes: list[bytes]):
        w = self.w = plan.kind.windows(b)
        key = w.anchor >> U64(plan.drop)
        known = np.concatenate([B.get_ints(x)[0] for x in notes]) if notes else np.zeros(0, U64)
        which = np.flatnonzero(member(key, np.sort(known)) >= 0)
        rows = plan.kind.rows(w, which)
        h = np.zeros(len(which), U64)
        for c in range(rows.shape[1]):
            h = mix(h + rows[:, c].astype(U64), 1)
        _, one, of = np.unique(h, return_index=True, return_inverse=True)
        # what only shares a hash with the first one is an entry of its own
        odd = np.flatnonzero((rows != rows[one[of]]).any(axis=1)) if len(which) else one
        of[odd] = len(one) + np.arange(len(odd))
        one = np.concatenate([one, odd])
        bucket = mix(key[which[one]], 2) >> U64(64 - plan.segment_bits)
        order = plan.kind.order(rows[one], bucket.astype(np.int64))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.segment, self.of = which, back[of]
        self.one, self.rows, self.bucket = which[one[order]], rows[one[order]], bucket[order].astype(np.int64)
        self.least = np.full(len(one), B.LAST)
        np.minimum.at(self.least, self.of, w.owner[which])

    def late(self, notes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Spans of symbols covered by windows that also start in an earlier document."""
        w = self.w
        again = self.segment[w.owner[self.segment] > self.least[self.of]]
        start, end = [w.first[again]], [w.last[again] + w.n]
        by = np.argsort(self.of, kind="stable")
        for note in notes:
            bucket, entry, lo, hi = (x.astype(np.int64) for x in B.get_ints(note))
            entry = entry + np.searchsorted(self.bucket, bucket[0])
            a, z = np.searchsorted(self.of[by], entry), np.searchsorted(self.of[by], entry, side="right")
            many = z - a
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(a, many)
            first = w.first[self.segment[by[at]]]
            start.append(first + np.repeat(lo, many)), end.append(first + np.repeat(hi, many) - 1 + w.n)
        return np.concatenate(start), np.concatenate(end)


def combine_anchors(runs: list[list[np.ndarray]]) -> list[bytes | None]:
    """Runs of (anchor, several): each block learns which of its anchors occur in two documents."""
    key = np.concatenate([r[0] for r in runs])
    several = np.concatenate([r[1] for r in runs]) > 0
    run = np.repeat(np.arange(len(runs)), [len(r[0]) for r in runs])
    order = np.argsort(key, kind="stable")
    k = key[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    count = np.diff(np.append(at, len(k)))
    keep = np.empty(len(k), bool)
    keep[order] = np.repeat((count > 1) | np.logical_or.reduceat(several[order], at), count)
    key, run = key[keep], run[keep]
    stop = np.searchsorted(run, np.arange(len(runs) + 1))
    return [B.put_ints((key[a:b], True)) if b > a else None for a, b in zip(stop[:-1], stop[1:])]


def _answers(bucket: int, sizes: list[int], entry: np.ndarray, t: np.ndarray) -> list[bytes | None]:
    """For each run its late windows, as (bucket; entry, from, to)."""
    order = np.lexsort((t, entry))
    entry, t = entry[order], t[order]
    new = np.ones(len(entry), bool)
    new[1:] = (entry[1:] != entry[:-1]) | (t[1:] != t[:-1] + 1)
    first = np.flatnonzero(new)
    entry, lo, hi = entry[first], t[first], t[np.append(first[1:], len(t)) - 1] + 1 if len(t) else t
    base = np.concatenate([[0], np.cumsum(sizes)])
    stop = np.searchsorted(entry, base)
    own = np.array([bucket])
    return [B.put_ints((own, False), (entry[a:z] - base[k], True), (lo[a:z], False), (hi[a:z], False)) if z > a else None for k, (a, z) in enumerate(zip(stop[:-1], stop[1:]))]


def find(docs: DataFrame, kind, block_bytes: int = B.BLOCK, carry: bool = False):
    """Blocks with the notes that ``Entries`` and its ``late`` need, and the plan that the passes share."""
    packed = B.pack(docs, block_bytes, carry)
    plan = Plan(kind, B.total_size(packed), partitions(docs.sparkSession))
    drop, width = U64(plan.drop), 64 - plan.drop

    def anchors(number, b, _):
        w = kind.windows(b)
        key, _, several = least_owner(w.anchor >> drop, w.owner)
        yield from B.runs_out(number, (key >> U64(width - plan.bits)).astype(np.int64), [(key, True), (several, False)])

    def segments(number, b, notes):
        e = Entries(plan, b, notes[0])
        if len(e.one):
            start = np.flatnonzero(np.concatenate([[True], e.bucket[1:] != e.bucket[:-1]]))
            runs = kind.runs(e.w, e.one, e.rows, e.least, start, np.append(start[1:], len(e.one)))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(e.bucket[start]), "block": pa.array(np.full(len(start), number, np.int64)), "run": pa.array(runs, pa.binary())})

    def combine(bucket: int, runs: list[bytes]):
        return _answers(bucket, *kind.combine(runs))

    known = B.gather(B.each_bucket(B.each_block(packed, anchors, 0, B.RUNS), lambda _, runs: combine_anchors([B.get_ints(r) for r in runs])))
    known = cut(known.withColumnRenamed("notes", "notes0").sortWithinPartitions("block"), placed=True)
    told = B.each_bucket(B.each_block(B.with_notes(packed, known), segments, 1, B.RUNS), combine)
    return B.with_notes(packed, known, told), plan
