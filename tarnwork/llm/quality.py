"""Quality by ordinal cumulative-link regression over hashed text.

Ratings are graded 0 (poor), 1 (sound but toxic), 2 (sound). One set of weights over hashed tokens
is shared by all grades; ordered thresholds cut the score: P(grade <= k) = sigmoid(t_k - score).
The fit is on a bounded sample of labelled rows (``max_rows`` and ``max_tokens``, by hash of doc_id, so
it doesn't depend on partitioning); everything else runs over all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.llm import blocks as B
from tarnwork.llm.bytesops import U64, Prefix, _SYMBOLS, arrow_bytes, give_back, lower_ascii, mix, pieces, runs, word_spans
from tarnwork.llm.common import cut, documents, small_batches

BITS = 17
#: Lengths in bytes of the word beginnings that count as tokens.
PREFIXES = (4, 5)
#: Words of a passage.
PASSAGE = 60
#: Bins of the text's shares and sizes have values up to this.
_TOP = 80
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
_OTHER = ~(_LETTER | _DIGIT | _BLANK)
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def passages(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of all passages (at least one a text) and, per text, the offsets into them."""
    start, _, cuts = word_spans(flat, offsets)
    place = np.arange(len(start)) - np.repeat(cuts[:-1], np.diff(cuts))
    begin = start[(place % PASSAGE == 0) & (place > 0)]
    doc = np.searchsorted(offsets, begin, side="right") - 1
    doc = np.concatenate([np.arange(len(offsets) - 1), doc])
    begin = np.concatenate([offsets[:-1], begin])
    order = np.lexsort((begin, doc))
    return np.append(begin[order], offsets[-1]), np.searchsorted(doc[order], np.arange(len(offsets)))


def pooled(scores: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Soft minimum of each text's passage scores, and the passages' shares in it."""
    count = np.diff(of)
    low = np.minimum.reduceat(scores, of[:-1])
    near = np.exp(np.repeat(low, count) - scores)
    total = np.add.reduceat(near, of[:-1])
    return low - np.log(total / count), near / np.repeat(total, count)


def _counts(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])


def _bin_keys(value: np.ndarray, kind: int, bits: int) -> np.ndarray:
    return (mix(value.astype(U64), 100 + kind) >> U64(64 - bits)).astype(np.int64)


def features(flat: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed tokens of each text, one text after the other, and the offsets into them.

    Tokens: words in lower case and their beginnings, runs of signs, and bins of a text's shares of capitals, signs,
    digits and distinct words, of its number of words and of their mean length.
    """
    n = len(offsets) - 1
    sums = Prefix(_SYMBOLS[1][lower_ascii(flat)])
    rows, keys = [], []
    words = np.zeros(n, np.int64)
    for kind, mask in ((1, _LETTER[flat]), (2, _OTHER[flat])):
        start, end, of = runs(mask, offsets)
        row = np.repeat(np.arange(n), np.diff(of))
        key = sums.spans(start, end, kind) >> U64(64 - bits)
        rows.append(row), keys.append(key.astype(np.int64))
        if kind == 1:
            words = np.diff(of)
            for size in PREFIXES:
                far = end - start > size
                rows.append(row[far])
                keys.append((sums.spans(start[far], start[far] + size, 10 + size) >> U64(64 - bits)).astype(np.int64))
    size = np.maximum(np.diff(offsets), 1)
    letters = _counts(_LETTER[flat], offsets)
    pair = np.unique((rows[0] << bits) | keys[0])
    distinct = np.bincount(pair >> bits, minlength=n)
    bins = [
        np.ceil(10 * _counts(_UPPER[flat], offsets) / np.maximum(letters, 1)),
        np.ceil(20 * _counts(_OTHER[flat], offsets) / size),
        np.ceil(20 * _counts(_DIGIT[flat], offsets) / size),
        np.floor(10 * distinct / np.maximum(words, 1) ** 0.8),
        np.floor(np.log2(words + 1.0)),
        np.minimum(np.floor(letters / np.maximum(words, 1)), 20),
    ]
    for kind, value in enumerate(bins):
        rows.append(np.arange(n))
        keys.append(_bin_keys(np.minimum(value, _TOP), kind, bits))
    both = np.unique((np.concatenate(rows) << bits) | np.concatenate(keys))
    return (both & ((1 << bits) - 1)).astype(np.int32), np.searchsorted(both >> bits, np.arange(n + 1))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class Ordinal:
    """Weights, thresholds and what follows from them."""

    def __init__(self, weights: np.ndarray, cuts: np.ndarray):
        self.weights, self.cuts = weights, cuts

    def grades(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and probability of the top grade."""
        above = [1.0 - _sigmoid(c - score) for c in self.cuts]
        return np.sum(above, axis=0), above[-1]

    def score(self, tokens: np.ndarray, offsets: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Scores of texts, given their passages' tokens."""
        if len(of) < 2:
            return np.zeros(0)
        return pooled(np.diff(np.concatenate([[0.0], np.cumsum(self.weights[tokens])])[offsets]), of)[0]


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges one after the other, and the offsets into them."""
    count = last - first
    cuts = np.concatenate([[0], np.cumsum(count)])
    return np.arange(cuts[-1]) - np.repeat(cuts[:-1] - first, count), cuts


def fit(tokens: np.ndarray, offsets: np.ndarray, of: np.ndarray, grade: np.ndarray, turn: np.ndarray, bits: int = BITS, l1: float = 3e-4, epochs: int = 20, pace: float = 0.1, seed: int = 3) -> Ordinal:
    """Adaptive gradient descent in seeded batches, drawn from the texts in the order of ``turn``, on the cumulative-link
    loss, with an L1 penalty.

    Returns the mean of the second half's weights and thresholds.
    """
    n, width, top, size = len(grade), 1 << bits, int(grade.max()), 128
    share = np.array([(grade <= k).mean() for k in range(top)]).clip(1e-3, 1 - 1e-3)
    cuts = np.log(share / (1 - share))
    w, seen, seen_cuts = np.zeros(width), np.full(width, 1e-8), np.full(top, 1e-4)
    mean_w, mean_cuts, parts = np.zeros(width), np.zeros(top), 0
    draw = np.random.default_rng(seed)
    for epoch in range(epochs):
        order = draw.permutation(n)
        for lo in range(0, n, size):
            who = turn[np.sort(order[lo : lo + size])]
            part, parted = _ranges(of[who], of[who + 1])
            at, cut = _ranges(offsets[part], offsets[part + 1])
            token, y = tokens[at], grade[who]
            row = np.repeat(np.arange(len(part)), np.diff(cut))
            score, weight = pooled(np.bincount(row, weights=w[token], minlength=len(part)), parted)
            edge = np.concatenate([[-40.0], cuts, [40.0]])
            a, b = _sigmoid(edge[y] - score), _sigmoid(edge[y + 1] - score)
            p = np.maximum(b - a, 1e-9)
            g = (b * (1 - b) - a * (1 - a)) / p / len(who)
            grad = np.bincount(token, weights=(np.repeat(g, np.diff(parted)) * weight)[row], minlength=width)
            up = np.bincount(y + 1, weights=-b * (1 - b) / p / len(who), minlength=top + 2)[1 : top + 1]
            down = np.bincount(y, weights=a * (1 - a) / p / len(who), minlength=top + 2)[1 : top + 1]
            seen += grad * grad
            seen_cuts += (up + down) ** 2
            step = pace / np.sqrt(seen)
            w -= step * grad
            w = np.sign(w) * np.maximum(np.abs(w) - np.minimum(step, 100.0) * l1, 0)
            cuts = np.sort(cuts - pace / np.sqrt(seen_cuts) * (up + down))
            if epoch >= epochs // 2:
                mean_w += w
                mean_cuts += cuts
                parts += 1
    return Ordinal(mean_w / parts, mean_cuts / parts)


#: Order of the labelled rows, that of their hashes: the first ones are the sample.
_TURN = ("turn", "doc_id", "grade", "content")


def draw_sample(docs: DataFrame, labels: DataFrame, max_rows: int, max_tokens: int, seed: int, bits: int) -> DataFrame:
    """(turn, doc_id, grade, content, passages, tokens, sample) of the first labelled rows by hash of doc_id: ``max_rows`` at
    most, and so many that they have ``max_tokens`` tokens at most. Equal rows count once, whatever share of all they are;
    a text of over a hundredth of ``max_tokens`` isn't drawn, so that none takes the place of all others.
    """
    small_batches(docs.sparkSession)
    grade = F.greatest(F.lit(0), 2 * F.col("quality") - F.coalesce("toxic", F.lit(0))).cast("int")
    rated = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade")).dropna()
    rated = rated.select(F.xxhash64(F.lit(seed), "doc_id").alias("turn"), "doc_id", "grade").orderBy("turn", "doc_id", "grade").limit(max_rows)

    def extract(it):
        for batch in it:
            flat, offsets = arrow_bytes(batch.column("text"))
            for lo, hi in pieces(offsets, 4_000_000):
                part, off = flat[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                begin, of = passages(part, off)
                tokens, cuts = features(part, begin, bits)
                at, sizes = cuts[of], np.diff(cuts)
                # tokens of each passage, tokens: packed, for the driver holds them all
                sample = [B.put_ints((sizes[of[i] : of[i + 1]], False), (tokens[at[i] : at[i + 1]], False)) for i in range(hi - lo)]
                known = [batch.column(c).slice(lo, hi - lo) for c in _TURN]
                yield pa.RecordBatch.from_arrays([*known, pa.array(np.diff(of)), pa.array(np.diff(at)), pa.array(sample, pa.binary())], names=[*_TURN, "passages", "tokens", "sample"])
            give_back()

    # the labels are bounded by max_rows, so they can be sent to every task
    joined = documents(docs).withColumn("content", F.xxhash64("text")).join(F.broadcast(rated), "doc_id").select(*_TURN, "text")
    kind = "turn long, doc_id long, grade int, content long, passages long, tokens long, sample binary"
    once = [F.first(c).alias(c) for c in ("passages", "tokens", "sample")]
    drawn = cut(joined.mapInArrow(extract, kind).filter(F.col("tokens") <= max_tokens // 100).groupBy(*_TURN).agg(*once))
    # a doc_id may have many texts; these are long integers of max_rows rows
    first = drawn.select(*_TURN, "tokens").orderBy(*_TURN).limit(max_rows).toArrow()
    fit_in = int(np.searchsorted(np.cumsum(first["tokens"].to_numpy()), max_tokens, side="right"))
    if fit_in == 0:
        return drawn
    last = F.struct(*[F.lit(first[c][fit_in - 1].as_py()).cast(drawn.schema[c].dataType).alias(c) for c in _TURN])
    return drawn.filter(F.struct(*_TURN) <= last)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 40_000, seed: int = 5, bits: int = BITS, max_tokens: int = 60_000_000) -> Ordinal | None:
    """Fits on at most ``max_rows`` labelled documents of at most ``max_tokens`` tokens; None if they show one grade only."""
    found = draw_sample(docs, labels, max_rows, max_tokens, seed, bits).select("doc_id", "grade", "content", "passages", "tokens", "sample").toArrow()
    ids, y, content, count, size = (found[c].to_numpy() for c in ("doc_id", "grade", "content", "passages", "tokens"))
    if len(np.unique(y)) < 2:
        return None
    # the fit goes by doc_id, not by the order in which the tasks end
    turn = np.lexsort((content, y, ids))
    of, at = (np.concatenate([[0], np.cumsum(n)]) for n in (count, size))
    tokens, sizes = np.empty(at[-1], np.int32), np.empty(of[-1], np.int64)
    i = 0
    for chunk in found["sample"].chunks:
        for packed in chunk:
            sizes[of[i] : of[i + 1]], tokens[at[i] : at[i + 1]] = B.get_ints(packed.as_py())
            i += 1
    del found
    give_back()
    return fit(tokens, np.concatenate([[0], np.cumsum(sizes)]), of, y.astype(np.int64), turn, bits)


def _grades(model: Ordinal | None, column: pa.Array, least: float, bits: int):
    """(first, last, expected grades, chances of the top grade, keep) of the texts, piece by piece."""
    flat, offsets = arrow_bytes(column)
    for lo, hi in pieces(offsets, 4_000_000):
        part, off = flat[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        keep = _counts(~_BLANK[part], off) > 0
        if model is None:
            yield lo, hi, pa.nulls(hi - lo, pa.float64()), pa.nulls(hi - lo, pa.float64()), keep
        else:
            begin, of = passages(part, off)
            tokens, cuts = features(part, begin, bits)
            mean, top = (np.round(np.where(keep, x, 0.0), 9) for x in model.grades(model.score(tokens, cuts, of)))
            yield lo, hi, pa.array(mean), pa.array(top), keep & (top >= least)
    give_back()


def grade_documents(docs: DataFrame, labels: DataFrame, least: float = 0.5, max_rows: int = 40_000, bits: int = BITS) -> DataFrame:
    """doc_id, expected_grade, p_top (probability of the top grade) and keep (p_top of ``least`` or more).

    Texts without words (null, empty, blank) are graded 0 and not kept. Where the labels show no
    two grades there is no model: grades are null and every text with words is kept. Rows of equal
    text get equal grades; unlabelled, doubly labelled and unknown doc_ids do no harm.
    """
    model = train(docs, labels, max_rows, bits=bits)

    def score(it):
        for batch in it:
            ids = batch.column("doc_id")
            for lo, hi, mean, top, keep in _grades(model, batch.column("text"), least, bits):
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), mean, top, pa.array(keep)], names=["doc_id", "expected_grade", "p_top", "keep"])

    return documents(docs).mapInArrow(score, "doc_id long, expected_grade double, p_top double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, max_rows: int = 40_000, bits: int = BITS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``grade_documents`` keeps."""
    model = train(docs, labels, max_rows, bits=bits)

    def choose(it):
        for batch in it:
            for lo, hi, _, _, keep in _grades(model, batch.column("text"), least, bits):
                yield batch.slice(lo, hi - lo).filter(pa.array(keep))

    return docs.mapInArrow(choose, docs.schema)
