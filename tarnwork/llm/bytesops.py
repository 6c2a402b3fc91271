"""Vectorised text primitives shared by the corpus operators.

Everything works on one flat byte array holding many documents back to back,
with an offsets array of n + 1 entries, so that no step loops over documents.
Hashes depend on content alone. They choose where rows meet and what is looked
at; nothing is taken as equal because its hashes are. Prefix hashes are
polynomials modulo 2**64, for short sequences of well mixed symbols; texts of any
length go through ``span_hash``.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}
#: Text is handled in pieces of about this many bytes; a longer document is one piece.
PIECE = 2_000_000


def give_back() -> None:
    """Returns freed memory to the system: workers are used again and would hold it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def arrow_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Flat bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, size: int = PIECE):
    """Ranges (first, last) of documents of about ``size`` bytes each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n:
        m = max(n, 1 << 16)
        _powers["up"] = np.cumprod(np.full(m, _BASE, U64))
        _powers["down"] = np.cumprod(np.full(m, _INVERSE, U64))
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x + U64((salt * 0xA24BAED4963EE407 + 0x9FB21C651E98DF25) & (2**64 - 1))
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def byte_symbols(seed: int = 1) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64), seed)


_SYMBOLS = {s: byte_symbols(s) for s in (1, 2)}


class Prefix:
    """Prefix sums that give the hash of any span of a symbol array in constant time."""

    def __init__(self, symbols: np.ndarray):
        up, self.down = powers(len(symbols) + 1)
        self.sums = np.empty(len(symbols) + 1, U64)
        self.sums[0] = 0
        np.cumsum(symbols * up[: len(symbols)], out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def spans(self, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        return mix(self.raw(start, end), salt)

    def grams(self, k: int, salt: int = 0) -> np.ndarray:
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, U64)
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n], salt)


def byte_prefix(flat: np.ndarray, seed: int = 1) -> Prefix:
    return Prefix(_SYMBOLS[seed][flat])


def eights(flat: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, zeros after the end."""
    padded = np.concatenate([flat, np.zeros(8, np.uint8)])
    return np.ndarray((len(flat) + 1,), "<u8", padded.tobytes(), strides=(1,))


def span_hash(flat: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of each span, eight bytes at a time, each mixed with its place in the span."""
    size = (end - start).astype(np.int64)
    many = (size + 7) >> 3
    out = mix(size.astype(U64), salt)
    if not many.sum():
        return out
    which = np.repeat(np.arange(len(size)), many)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
    value = eights(flat)[start[which] + 8 * nth]
    left = np.minimum(size[which] - 8 * nth, 8).astype(U64)
    value &= U64(2**64 - 1) >> (U64(64) - U64(8) * left)
    value = mix(value ^ mix(nth.astype(U64), salt + 1), salt + 2)
    some = np.flatnonzero(many)
    out[some] += np.add.reduceat(value, (np.cumsum(many) - many)[some])
    return mix(out, salt + 3)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U64(by)) | (x >> U64(64 - by))


def byte_grams(flat: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` bytes in a row, ``k`` being eight or more."""
    n = len(flat) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    part = np.ascontiguousarray(eights(flat)[: len(flat) - 7])
    part ^= part >> U64(29)
    part *= U64(0xBF58476D1CE4E5B9)
    part ^= part >> U64(32)
    out = part[:n].copy()
    for turn, at in enumerate([*range(8, k - 7, 8), *([k - 8] if k % 8 else [])], 1):
        out += _turn(part[at : at + n], 23 * turn % 64)
    out ^= out >> U64(31)
    out *= U64(0x94D049BB133111EB)
    out ^= out >> U64(32)
    return out


def tokens(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the spans by their content, equal for equal bytes only; and the hash of each number's content."""
    size = end - start
    cuts = np.concatenate([[0], np.cumsum(size)])
    text = flat[np.arange(cuts[-1]) + np.repeat(start - cuts[:-1], size)]
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(text)])
    coded = spans.dictionary_encode()
    data, at = arrow_bytes(coded.dictionary)
    return coded.indices.to_numpy().astype(np.int64), span_hash(data, at[:-1], at[1:], 7)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_spans(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and, per document, the offsets into them."""
    return runs(~_SPACE[flat], offsets)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal true runs that stay within documents; per document, the offsets into them."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lower_ascii(flat: np.ndarray) -> np.ndarray:
    upper = (flat >= 65) & (flat <= 90)
    return np.where(upper, flat + np.uint8(32), flat)


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of ``w`` values."""
    n = len(h)
    if n < w:
        return np.zeros(0, h.dtype)
    if w == 1:
        return h
    m = -(-n // w) * w
    padded = np.full(m, np.iinfo(h.dtype).max, h.dtype)
    padded[:n] = h
    rows = padded.reshape(-1, w)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Position of each value in the sorted table, or -1."""
    if len(table) == 0:
        return np.full(len(values), -1, np.int64)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return np.where(table[at] == values, at, -1)


def cover(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mask of the positions that lie in any of the spans."""
    depth = np.bincount(start, minlength=n + 1)[: n + 1] - np.bincount(end, minlength=n + 1)[: n + 1]
    return np.cumsum(depth)[:n] > 0
