"""Removal of word passages that also occur in an earlier document, by phrase automata.

Every window of words belongs to one shard, that of its anchor (see ``repeats``), and every document's
passages go to the shards of their anchors. A shard confirms which windows of what it receives recur,
compiles each, as its earliest owner has it, into an Aho-Corasick automaton over words, and streams the
passages that hold any through it. The occurrences that the automaton reports, and these alone, are removed from the
documents that come after a window's first owner.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.llm import blocks as B
from tarnwork.llm import repeats as R
from tarnwork.llm.bytesops import U64, Prefix, cover, mix, word_spans

WINDOW = 13


def words_of(b: B.Block):
    return *word_spans(b.flat, b.offsets), None


def join_words(flat: np.ndarray, start: np.ndarray, end: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The words of each document, joined by one space; ``cuts`` are the documents' offsets into the words."""
    size = end - start
    last = np.zeros(len(start), bool)
    last[cuts[1:][cuts[1:] > cuts[:-1]] - 1] = True
    stop = np.cumsum(size + ~last)
    begin = stop - size - ~last
    out = np.full(int(stop[-1]) if len(stop) else 0, 0x20, np.uint8)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[at + np.repeat(begin, size)] = flat[at + np.repeat(start, size)]
    offsets = np.concatenate([[0], stop])[cuts]
    return pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out.tobytes()))


def automaton(names: list[int], start: list[int], size: int, owner: list[int]):
    """Compiles the windows that begin at the given places, each with its owner."""
    out = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for a, o in zip(start, owner):
        out.add_word(tuple(names[a : a + size]), o)
    out.make_automaton()
    return out


#: Passages that an automaton should be compiled from about: a small one stays in the processor's cache.
SHARD = 2000


def _by_content(number: np.ndarray, place: np.ndarray, own: np.ndarray, first: np.ndarray, some: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """One window for each content that several owners have, the first owner's, and the windows in question.

    ``first`` and ``some`` are those of the groups of one hash with several owners. A group of several contents is told
    apart by the words themselves; windows of one content have one owner at least in ``first``.
    """
    group = np.searchsorted(key[first], key[some])
    alike = np.ones(len(some), bool)
    for k in range(n):
        alike &= number[place[some] + k] == number[place[first][group] + k]
    mixed = np.unique(group[~alike])
    if not len(mixed):
        return first, some
    inside = np.isin(group, mixed)
    kinds: dict[tuple, list[int]] = {}
    # windows come by owner, so that the first of a content is its first owner's
    for at in some[inside].tolist():
        kinds.setdefault(tuple(number[place[at] : place[at] + n].tolist()), []).append(at)
    more = [x for x in kinds.values() if own[x[0]] != own[x[-1]]]
    first = np.sort(np.concatenate([np.delete(first, mixed), np.array([x[0] for x in more], np.int64)]))
    return first, np.sort(np.concatenate([some[~inside], np.array([at for x in more for at in x], np.int64)]))


def locate(number: np.ndarray, count: np.ndarray, owner: np.ndarray, n: int, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences (entry, place) of windows that an earlier owner holds too, among entries of ``count`` windows each.

    Entries that can have a window in common have equal ``shard`` numbers.
    """
    size = count + n - 1
    begin = np.cumsum(size) - size
    entry = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count) + begin[entry]
    # the automaton holds what several owners have, as the first of them has it
    key, own = Prefix(mix(number.astype(U64), 4)).grams(n)[place], owner[entry]
    order = np.lexsort((own, key))
    key, own, place, entry = key[order], own[order], place[order], entry[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    several = np.maximum.reduceat(own, first) != own[first] if len(first) else new
    first, some = _by_content(number, place, own, first[several], np.flatnonzero(np.repeat(several, np.diff(np.append(first, len(key))))), key, n)
    # passages with such a window are streamed, shard by shard
    streamed = np.unique(entry[some])
    part = mix(shard, 3) % U64(len(count) // SHARD + 1)
    compiled, streamed = first[np.argsort(part[entry[first]], kind="stable")], streamed[np.argsort(part[streamed], kind="stable")]
    parts = np.unique(part[streamed])
    edges = [np.searchsorted(part[x], parts, side=side) for x in (entry[compiled], streamed) for side in ("left", "right")]
    names = number.tolist()
    entries, places = [], []
    for a, z, lo, hi in zip(*(e.tolist() for e in edges)):
        found = automaton(names, place[compiled[a:z]].tolist(), n, own[compiled[a:z]].tolist())
        who = streamed[lo:hi]
        for e, at, many, mine in zip(who.tolist(), begin[who].tolist(), size[who].tolist(), owner[who].tolist()):
            for end, one in found.iter(tuple(names[at : at + many])):
                if one < mine:
                    entries.append(e)
                    places.append(end - n + 1)
    return np.array(entries, np.int64), np.array(places, np.int64)


def remove_phrases(docs: DataFrame, block_bytes: int = B.BLOCK) -> DataFrame:
    """Removes each word covered by 13 consecutive words that also start in a document of smaller doc_id.

    Returns doc_id, n_words, n_removed and kept (the words left, joined by one space). Null text has
    no words; shorter texts are kept whole; rows that repeat a doc_id are documents of equal rank; a
    null doc_id ranks last; an empty table gives an empty result; other columns, of any name, don't matter.
    """
    # bytes per word are at least 2, bar the last one
    found, plan = R.find(docs, R.Sequences(words_of, locate, WINDOW, 6, 1 / 6), block_bytes)

    def remove(number, b, notes):
        e = R.Entries(plan, b, notes[0])
        start, end, cuts = e.w.start, e.w.end, e.w.cuts
        gone = cover(len(start), *e.late(notes[1]))
        left = np.concatenate([[0], np.cumsum(~gone)])[cuts]
        yield pa.RecordBatch.from_arrays(
            [b.id_array(), pa.array(np.diff(cuts)), pa.array(np.diff(cuts) - np.diff(left)), join_words(b.flat, start[~gone], end[~gone], left)], names=["doc_id", "n_words", "n_removed", "kept"]
        )

    return B.each_block(found, remove, 2, "doc_id long, n_words long, n_removed long, kept string")


def digest(removed: DataFrame) -> DataFrame:
    """Counts and hash of what ``remove_phrases`` kept; one row a document, nulls and empty texts too."""
    return removed.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d)),
m AS (SELECT s, min(doc_id) AS first_id FROM s GROUP BY s),
late AS (SELECT doc_id, i FROM s JOIN m USING (s) WHERE first_id < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i, unnest(range(0, 13)) AS j FROM late)),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT p.doc_id, count(*) AS n, string_agg(p.w[p.p], ' ' ORDER BY p.p) AS kept
         FROM p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.p = g.p WHERE g.p IS NULL GROUP BY p.doc_id)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
