"""Sampled segmentation into sentence pieces, and lossless decoding.

A text is read as UTF-8 bytes with one space put before it. No piece holds a space after another
character, nor a line break beside anything, so the piece lattice falls apart into units that are
cut before each space that ends a word and around each line break. For every distinct unit of a
batch the forward probabilities are filtered once; every occurrence then samples backwards, with
uniform numbers from a hash of seed, row key, place of the unit in its row and lattice node. A
sampled segmentation so depends on the row alone, not on batches or on the machine.

Pieces weigh 1 / (rank + 2.7) to the power of ``sharpness``, ranks being the model's merge order.
Characters that are no piece take byte pieces.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.bytesops import U64, Prefix, _SYMBOLS, arrow_bytes, give_back, mix, pieces, span_hash
from tarnwork.llm.common import small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_SPACE = "▁"
#: Units up to this many bytes are filtered together by length, longer ones one by one.
SHORT = 48
_BATCH = 1_000_000
_models: dict[tuple, Lattice] = {}


class Lattice:
    def __init__(self, model: str, sharpness: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_id = np.full(256, -1, np.int32)
        words: dict[bytes, int] = {}
        for i in range(n):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:5], 16)
                self.byte_id[value], self.bytes_of[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.bytes_of[i] = sp.id_to_piece(i).replace(_SPACE, " ").encode()
                words[self.bytes_of[i]] = i
        self.words = {w: i for w, i in words.items() if w and (b" " not in w.lstrip(b" ")) and b"\n" not in w}
        rank = np.array([max(-sp.get_score(i), 0.0) for i in range(n)])
        rank[rank > n] = n
        self.weight = (rank + 2.7) ** -sharpness
        self.byte_weight = (8.0 * n) ** -sharpness
        self.longest = max(map(len, self.words))
        self.table = pa.array(self.bytes_of, pa.binary())
        self._hash()

    def _hash(self):
        size = 1 << 18
        self.slot_hash, self.slot_id, self.mask = np.zeros(size, U64), np.full(size, -1, np.int32), U64(size - 1)
        self.lengths = sorted({len(w) for w in self.words})
        self.probes = 1
        for w, i in self.words.items():
            h = Prefix(_SYMBOLS[1][np.frombuffer(w, np.uint8)]).spans(np.array([0]), np.array([len(w)]), len(w))[0]
            at, tries = int(h & self.mask), 1
            while self.slot_id[at] >= 0:
                at, tries = (at + 1) % size, tries + 1
            self.slot_hash[at], self.slot_id[at] = h, i
            self.probes = max(self.probes, tries)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each span hash, or -1."""
        at = (h & self.mask).astype(np.int64)
        out = np.where(self.slot_hash[at] == h, self.slot_id[at], -1)
        open_ = np.flatnonzero((out < 0) & (self.slot_id[at] >= 0))
        for k in range(1, self.probes):
            if not len(open_):
                break
            spot = (at[open_] + k) & int(self.mask)
            hit = self.slot_hash[spot] == h[open_]
            out[open_[hit]] = self.slot_id[spot[hit]]
            open_ = open_[~hit & (self.slot_id[spot] >= 0)]
        return out

    def edges(self, flat: np.ndarray, start: np.ndarray, length: int):
        """Of units of one length: the edges by (unit, end node), with the share of what reaches the node; and the units
        that need logarithms, of which there are no edges here."""
        n, j = len(start), np.arange(length)
        grid = flat[start[:, None] + j]
        sums = Prefix(_SYMBOLS[1][grid.ravel()])
        place = (np.arange(n) * length)[:, None]
        alpha = np.zeros((n, length + 1))
        alpha[:, 0] = 1
        found = {}
        for size in self.lengths:
            if size > length:
                break
            at = (place + np.arange(length - size + 1)).ravel()
            found[size] = self.find(sums.spans(at, at + size, size)).reshape(n, -1)
        lead = (grid & 0xC0) != 0x80
        wide = np.where(grid < 0x80, 1, np.where(grid < 0xE0, 2, np.where(grid < 0xF0, 3, 4)))
        known = np.zeros((n, length), bool)
        for size in (1, 2, 3, 4):
            if size in found:
                ok = found[size] >= 0
                known[:, : ok.shape[1]] |= ok & lead[:, : ok.shape[1]] & (wide[:, : ok.shape[1]] == size)
        # a character's trailing bytes follow its first byte
        first = np.maximum.accumulate(np.where(lead, j, 0), axis=1)
        bare = ~np.take_along_axis(known, first, axis=1)
        parts = []
        for end in range(1, length + 1):
            for size, ids in found.items():
                if size > end:
                    break
                piece = ids[:, end - size]
                rows = np.flatnonzero(piece >= 0)
                if len(rows):
                    p = alpha[rows, end - size] * self.weight[piece[rows]]
                    alpha[rows, end] += p
                    parts.append((rows, end, end - size, piece[rows], p))
            rows = np.flatnonzero(bare[:, end - 1])
            if len(rows):
                p = alpha[rows, end - 1] * self.byte_weight
                alpha[rows, end] += p
                parts.append((rows, end, end - 1, self.byte_id[grid[rows, end - 1]], p))
        rows = np.concatenate([x[0] for x in parts])
        sizes = [len(x[0]) for x in parts]
        end, back = np.repeat([x[1] for x in parts], sizes), np.repeat([x[2] for x in parts], sizes)
        piece, p = np.concatenate([x[3] for x in parts]), np.concatenate([x[4] for x in parts])
        order = np.argsort(rows * (length + 1) + end, kind="stable")
        rows, end, back, piece, p = (x[order] for x in (rows, end, back, piece, p))
        # no weight is over 1, so what reaches the last node is no more than what reaches any node on its way
        low = alpha[:, length] < 1e-250
        use = (p > 0) & ~low[rows]
        return (rows[use], end[use], back[use], piece[use], p[use] / alpha[rows[use], end[use]]), np.flatnonzero(low)

    def long_edges(self, unit: np.ndarray):
        """The same of one long unit, in logarithms."""
        n = len(unit)
        sums = Prefix(_SYMBOLS[1][unit])
        found = []
        for size in self.lengths:
            if size > n:
                break
            at = np.arange(n - size + 1)
            ids = self.find(sums.spans(at, at + size, size))
            at = at[ids >= 0]
            found.append((at + size, at, ids[at], np.log(self.weight[ids[at]])))
        # bytes of characters that are no piece
        lead = (unit & 0xC0) != 0x80
        first = np.maximum.accumulate(np.where(lead, np.arange(n), 0))
        wide = np.where(unit < 0x80, 1, np.where(unit < 0xE0, 2, np.where(unit < 0xF0, 3, 4)))
        known = np.zeros(n, bool)
        for end, at, _, _ in found:
            known[at[lead[at] & (end - at == wide[at])]] = True
        at = np.flatnonzero(~known[first])
        found.append((at + 1, at, self.byte_id[unit[at]].astype(np.int64), np.full(len(at), math.log(self.byte_weight))))
        end, back, ids, cost = (np.concatenate([f[k] for f in found]) for k in range(4))
        order = np.lexsort((back, end))
        end, back, ids, cost = end[order], back[order], ids[order], cost[order]
        stop = np.searchsorted(end, np.arange(n + 2)).tolist()
        backs, costs = back.tolist(), cost.tolist()
        alpha, share = [0.0] + [-math.inf] * n, []
        for e in range(1, n + 1):
            here = [alpha[backs[k]] + costs[k] for k in range(stop[e], stop[e + 1])]
            top = max(here, default=-math.inf)
            if top > -math.inf:
                alpha[e] = top + math.log(sum(math.exp(x - top) for x in here))
                share += [math.exp(x - alpha[e]) for x in here]
            else:
                share += [0.0] * len(here)
        share = np.array(share)
        use = share > 0
        return np.zeros(int(use.sum()), np.int64), end[use], back[use], ids[use], share[use]


def lattice(model: str, sharpness: float) -> Lattice:
    if (model, sharpness) not in _models:
        _models[model, sharpness] = Lattice(model, sharpness)
    return _models[model, sharpness]


def _units(flat: np.ndarray, offsets: np.ndarray):
    """Texts with a space before each that isn't empty, and the starts of their units."""
    sizes = np.diff(offsets)
    lead = (sizes > 0).astype(np.int64)
    out = np.concatenate([[0], np.cumsum(sizes + lead)])
    full = np.full(out[-1], 0x20, np.uint8)
    keep = np.ones(out[-1], bool)
    keep[out[:-1][lead > 0]] = False
    full[keep] = flat
    space, line = full == 0x20, full == 0x0A
    cut = np.zeros(len(full), bool)
    cut[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
    cut[out[:-1][lead > 0]] = True
    return full, out, np.flatnonzero(cut)


def sample(model: Lattice, flat: np.ndarray, offsets: np.ndarray, keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts one after the other, and the offsets into them."""
    full, out, start = _units(flat, offsets)
    if not len(start):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    end = np.append(start[1:], len(full))
    row = np.searchsorted(out, start, side="right") - 1
    ordinal = np.arange(len(start)) - np.searchsorted(start, out[:-1])[row]
    kinds, first, of = np.unique(span_hash(full, start, end), return_index=True, return_inverse=True)
    size = (end - start)[first]
    order = np.argsort(size, kind="stable")
    base = np.empty(len(kinds), np.int64)
    base[order] = np.concatenate([[0], np.cumsum(size[order] + 1)[:-1]])
    parts = []
    lengths, at = np.unique(size[order], return_index=True)
    for length, lo, hi in zip(lengths, at, np.append(at[1:], len(order))):
        who = order[lo:hi]
        groups, alone = [], who
        if length <= SHORT:
            edges, low = model.edges(full, start[first[who]], int(length))
            groups, alone = [(who, edges)], who[low]
        groups += [(alone[k : k + 1], model.long_edges(full[start[first[w]] : end[first[w]]])) for k, w in enumerate(alone)]
        for who, (rows, ends, backs, ids, share) in groups:
            parts.append((base[who[rows]] + ends, base[who[rows]] + backs, ids.astype(np.int32), share))
    node, back, ids, share = (np.concatenate([p[k] for p in parts]) for k in range(4))
    # within a node the shares add up to 1: sorted by node, one search finds the edge
    total = np.cumsum(share)
    begin = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    before = np.concatenate([[0.0], total])[begin]
    count = np.diff(np.append(begin, len(node)))
    inner = total - np.repeat(before, count)
    inner[begin + count - 1] = 1.0
    ladder = node + np.minimum(inner, 1.0)
    where = base[of] + size[of]
    floor = base[of]
    noise = mix(mix(keys.astype(U64), seed)[row] + ordinal.astype(U64) * U64(0xC2B2AE3D27D4EB4F), 3)
    live, steps, got = np.arange(len(start)), np.zeros(len(start), np.int64), []
    while len(live):
        u = mix(noise[live] + (where[live] - floor[live]).astype(U64), 5) >> U64(11)
        spot = np.searchsorted(ladder, where[live] + (u.astype(np.float64) + 0.5) * 2.0**-53, side="left")
        got.append((live, ids[spot]))
        where[live] = back[spot]
        steps[live] += 1
        live = live[where[live] > floor[live]]
    stop = np.cumsum(steps)
    result = np.empty(stop[-1], np.int32)
    for k, (who, piece) in enumerate(got):
        result[stop[who] - 1 - k] = piece
    cuts = np.concatenate([[0], stop])[np.searchsorted(start, out)]
    return result, cuts


def spell(model: Lattice, ids: np.ndarray) -> pa.Array:
    return model.table.take(pa.array(ids))


def decode_arrays(model: Lattice, ids: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the decoded texts, without the space that was put before them."""
    flat, offsets = arrow_bytes(spell(model, ids))
    out = offsets[cuts]
    has = out[1:] > out[:-1]
    keep = np.ones(len(flat), bool)
    keep[out[:-1][has]] = False
    return flat[keep], out - np.concatenate([[0], np.cumsum(has)])


def encode(docs: DataFrame, seed: int = 11, sharpness: float = 1.0, model: str = MODEL) -> DataFrame:
    """Adds nothing to the table: returns doc_id, pieces (array of int), n_pieces and lossless.

    The sample is seeded by doc_id (null counts as a key of its own, so repeated rows get the same
    sample). Null and empty texts give an empty array; a text of any length is segmented whole.
    """

    def batches(it):
        m = lattice(model, sharpness)
        for batch in it:
            flat, offsets = arrow_bytes(batch.column("text"))
            ids = batch.column("doc_id")
            keys = ids.fill_null(-(2**62)).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi in pieces(offsets, _BATCH):
                part, off = flat[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                got, cuts = sample(m, part, off, keys[lo:hi], seed)
                text, back = decode_arrays(m, got, cuts)
                if np.array_equal(back, off) and np.array_equal(text, part):
                    same = np.ones(hi - lo, bool)
                else:
                    same = np.array([text[back[k] : back[k + 1]].tobytes() == part[off[k] : off[k + 1]].tobytes() for k in range(hi - lo)])
                values = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(got, pa.int32()))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), values, pa.array(np.diff(cuts), pa.int64()), pa.array(same)], names=["doc_id", "pieces", "n_pieces", "lossless"])
            give_back()

    small_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(batches, "doc_id long, pieces array<int>, n_pieces long, lossless boolean")


def decode(encoded: DataFrame, model: str = MODEL, sharpness: float = 1.0) -> DataFrame:
    """doc_id and text of encoded rows; null or empty pieces give an empty text."""

    def batches(it):
        m = lattice(model, sharpness)
        for batch in it:
            lists = batch.column("pieces").cast(pa.list_(pa.int32())).fill_null(pa.scalar([], pa.list_(pa.int32())))
            values = lists.flatten().to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            text, back = decode_arrays(m, values, cuts)
            made = pa.LargeStringArray.from_buffers(len(lists), pa.py_buffer(back.astype(np.int64)), pa.py_buffer(text.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), made.cast(pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "pieces").mapInArrow(batches, "doc_id long, text string")
