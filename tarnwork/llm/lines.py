"""Removal of repeated runs of lines by winnowing over line hashes.

Blank lines aside, every two consecutive lines make a window; the least line hash of a window is its
fingerprint, so that a repeated run of two lines or more is sure to share one. Positions under the
same fingerprint are joined and the lines to both sides matched by their text (see ``repeats``), and of
each repeated run the later ones go. A line of many words can make a window by itself: it counts as two
symbols.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwork.llm import blocks as B
from tarnwork.llm import repeats as R
from tarnwork.llm.bytesops import _SPACE, cover, runs

RUN = 2
#: Words of a line that counts as a run by itself, where single lines count.
LONG = 13


def _lines(b: B.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines that aren't blank, and the documents' offsets into them."""
    start, end, cuts = runs(b.flat != 0x0A, b.offsets)
    ink = np.concatenate([[0], np.cumsum(~_SPACE[b.flat])])
    full = ink[end] > ink[start]
    return start[full], end[full], np.concatenate([[0], np.cumsum(full)])[cuts]


def _line_of_symbols(b: B.Block, start: np.ndarray, end: np.ndarray, long_words: int | None) -> np.ndarray:
    """Each symbol's line; a line of ``long_words`` words or more has two symbols, others one."""
    times = np.ones(len(start), np.int64)
    if long_words is not None:
        ink = ~_SPACE[b.flat]
        begins = ink.copy()
        begins[1:] &= ~ink[:-1]
        # a document's first byte begins a word whatever ends the one before
        opens = b.offsets[:-1][np.diff(b.offsets) > 0]
        begins[opens] = ink[opens]
        words = np.concatenate([[0], np.cumsum(begins)])
        times += words[end] - words[start] >= long_words
    return np.repeat(np.arange(len(start)), times)


def line_tokens(b: B.Block, long_words: int | None = None):
    """Lines as tokens, the second symbols of long ones marked."""
    start, end, cuts = _lines(b)
    line = _line_of_symbols(b, start, end, long_words)
    second = np.zeros(len(line), bool)
    second[1:] = line[1:] == line[:-1]
    return start[line], end[line], np.searchsorted(line, cuts), second


def _again(w: R.Windows) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the windows that the same document holds before."""
    if not len(w.number):
        return w.number, w.number
    at = np.arange(len(w.number) - 1)
    doc = np.repeat(np.arange(len(w.ids)), np.diff(w.cuts))
    at = at[doc[1:] == doc[:-1]]
    order = np.lexsort((at, w.number[at + 1], w.number[at], doc[at]))
    a = at[order]
    same = np.zeros(len(a), bool)
    same[1:] = (w.number[a[1:]] == w.number[a[:-1]]) & (w.number[a[1:] + 1] == w.number[a[:-1] + 1]) & (doc[a[1:]] == doc[a[:-1]])
    return a[same], a[same] + w.n


def _cut_lines(docs: DataFrame, block_bytes: int, long_words: int | None) -> tuple[DataFrame, dict[str, str]]:
    """Rows (doc_id, text, lines, removed, bytes_removed, and the other columns as _0, _1, ...), and each column's name there."""
    # a line of prose has some dozens of bytes; the widths only need the right order of size
    kind = R.Sequences(partial(line_tokens, long_words=long_words), R.by_pairs, RUN, 1, 1 / 32)
    found, plan = R.find(docs, kind, block_bytes, carry=True)
    rest_of = {c: f"_{i}" for i, c in enumerate(c for c in docs.columns if c not in ("doc_id", "text"))}

    def remove(number, b, notes):
        start, end, cuts = _lines(b)
        line = _line_of_symbols(b, start, end, long_words)
        e = R.Entries(plan, b, notes[0])
        lo, hi = e.late(notes[1])
        again = _again(e.w)
        gone = np.zeros(len(start), bool)
        gone[line[cover(len(line), np.concatenate([lo, again[0]]), np.concatenate([hi, again[1]]))]] = True
        drop = cover(len(b.flat), start[gone], np.minimum(end[gone] + 1, b.offsets[1:][np.searchsorted(cuts, np.flatnonzero(gone), side="right") - 1]))
        # the last line's own feed stands before it
        kept = np.concatenate([[0], np.cumsum(~drop)])[b.offsets]
        flat = b.flat[~drop]
        changed = np.diff(kept) < np.diff(b.offsets)
        ended = b.flat[np.maximum(b.offsets[1:] - 1, 0)] == 0x0A if len(b.flat) else np.zeros(len(b.ids), bool)
        trail = changed & ~ended & (np.diff(kept) > 0)
        trail[trail] = flat[kept[1:][trail] - 1] == 0x0A
        keep = np.ones(len(flat), bool)
        keep[kept[1:][trail] - 1] = False
        kept = kept - np.concatenate([[0], np.cumsum(trail)])
        count = np.concatenate([[0], np.cumsum(gone)])[cuts]
        text = pa.StringArray.from_buffers(len(b.ids), pa.py_buffer(kept.astype(np.int32)), pa.py_buffer(flat[keep].tobytes()))
        missing, *rest = B.rest_columns(b.rest)
        text = pa.compute.if_else(missing, pa.nulls(len(text), pa.string()), text)
        less = np.diff(b.offsets) - np.diff(kept)
        yield pa.RecordBatch.from_arrays([b.id_array(), text, pa.array(np.diff(cuts)), pa.array(np.diff(count)), pa.array(less), *rest], names=["doc_id", "text", "lines", "removed", "bytes_removed", *rest_of.values()])

    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())] + [T.StructField(c, T.LongType()) for c in ("lines", "removed", "bytes_removed")]
    out = B.each_block(found, remove, 2, T.StructType(fields + [T.StructField(k, docs.schema[n].dataType) for n, k in rest_of.items()]))
    return out, {c: rest_of.get(c, c) for c in docs.columns}


def remove_repeated_lines(docs: DataFrame, block_bytes: int = B.BLOCK, long_words: int | None = None) -> DataFrame:
    """Removes each line covered by two consecutive lines that also start earlier: in a document of smaller
    doc_id, or before in the same one; with ``long_words`` also each line of so many words that stands earlier.

    Returns the columns of ``docs`` with the text that is left, and n_lines and n_removed, unless ``docs`` has
    columns of that name. Lines end at line feeds; a removed line goes with its line feed; blank lines count
    nowhere and stay. Null text stays null and has no lines. Rows that repeat a doc_id are documents of equal
    rank; a null doc_id ranks last; an empty table gives an empty result.
    """
    out, name = _cut_lines(docs, block_bytes, long_words)
    counts = [F.col(c).alias(f"n_{c}") for c in ("lines", "removed") if f"n_{c}" not in docs.columns]
    return out.select(*[F.col(name[c]).alias(c) for c in docs.columns], *counts)


def keep_fresh(docs: DataFrame, long_words: int | None = LONG, most: float = 0.75) -> DataFrame:
    """The rows of ``docs`` without repeated lines, and without the documents that lose ``most`` of their bytes and of
    their lines or more.

    What is left of those is no document of its own: they are copies of earlier ones but for some lines. A document
    whose own lines are many stays, however long the repeated ones are. Rows
    without lines (null, empty or blank text) stay as they are; n_chars, where there is such a column, follows the text.
    """
    out, name = _cut_lines(docs, B.BLOCK, long_words)
    whole = F.col("bytes_removed") + F.octet_length(F.coalesce("text", F.lit("")))
    out = out.filter((F.col("removed") == 0) | (F.col("bytes_removed") < F.lit(most) * whole) | (F.col("removed") < F.lit(most) * F.col("lines")))
    chars = F.when(F.col("removed") > 0, F.length("text"))
    kept = {c: F.col(name[c]) for c in docs.columns}
    if "n_chars" in kept:
        kept["n_chars"] = F.coalesce(chars, kept["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*[v.alias(c) for c, v in kept.items()])


def digest(removed: DataFrame) -> DataFrame:
    """Counts and hash of the text that is left; a null text counts as empty."""
    return removed.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, 1 + len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
s AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS next
      FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
w AS (SELECT *, next IS NOT NULL AND (min(doc_id) OVER (PARTITION BY line, next) < doc_id OR min(i) OVER (PARTITION BY line, next, doc_id) < i) AS late FROM s),
g AS (SELECT doc_id, pos, coalesce(late, false) OR coalesce(lag(late) OVER (PARTITION BY doc_id ORDER BY pos), false) AS gone FROM w),
k AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS kept FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos WHERE NOT coalesce(g.gone, false) GROUP BY l.doc_id),
n AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n_lines, 0) AS n_lines, coalesce(n.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""

SQL_LONG = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, 1 + len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
s AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS next,
        len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) >= {LONG} AS long FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
w AS (SELECT *, next IS NOT NULL AND (min(doc_id) OVER (PARTITION BY line, next) < doc_id OR min(i) OVER (PARTITION BY line, next, doc_id) < i) AS late,
        long AND (min(doc_id) OVER (PARTITION BY line) < doc_id OR min(i) OVER (PARTITION BY line, doc_id) < i) AS again FROM s),
g AS (SELECT doc_id, pos, again OR coalesce(late, false) OR coalesce(lag(late) OVER (PARTITION BY doc_id ORDER BY pos), false) AS gone FROM w),
k AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS kept FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos WHERE NOT coalesce(g.gone, false) GROUP BY l.doc_id),
n AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n_lines, 0) AS n_lines, coalesce(n.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""
