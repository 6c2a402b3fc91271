"""Texts as words of digits, letters and non-ASCII characters, A-Z lowered, joined by one space."""

from __future__ import annotations

import numpy as np

#: The words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text; UTF-8 bytes over 0x7F are all inside.
SPACE = 0x20
_TO = np.full(256, SPACE, np.uint8)
for _lo, _hi in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    _TO[_lo : _hi + 1] = np.arange(_lo, _hi + 1)
_TO[0x41:0x5B] = np.arange(0x61, 0x7B)


class Words:
    """Documents as `` w1 w2 ... wn `` each, one after another; a document without words is one space.

    ``text``: the bytes; ``begin``: the documents' offsets into them; ``first``, ``stop``: each word's span;
    ``cuts``: the documents' offsets into the words. Two spaces in a row are a boundary of documents only.
    """

    def __init__(self, flat: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        text = np.insert(_TO[flat], np.concatenate([offsets[:-1], offsets[1:]]), SPACE) if n else np.zeros(0, np.uint8)
        start = offsets[:-1] + 2 * np.arange(n)
        inside = text != SPACE
        keep = inside.copy()
        keep[1:] |= inside[:-1]
        keep[start] = True
        self.text = text[keep]
        self.begin = np.concatenate([[0], np.cumsum(np.add.reduceat(keep, start, dtype=np.int64))]) if n else np.zeros(1, np.int64)
        inside = self.text != SPACE
        edge = inside[1:] != inside[:-1]
        edges = np.flatnonzero(edge) + 1
        # a text starts and ends with a space, so the edges are starts and ends by turns
        self.first, self.stop = edges[0::2], edges[1::2]
        self.cuts = np.searchsorted(self.first, self.begin)

    def counts(self) -> np.ndarray:
        return np.diff(self.cuts)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, last word and document of each run of ``n`` words."""
        many = np.maximum(self.counts() - n + 1, 0)
        doc = np.repeat(np.arange(len(many)), many)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + self.cuts[doc]
        return at, at + n - 1, doc
