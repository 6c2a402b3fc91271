"""Approximate nearest neighbours over balanced posting lists.

Centroids come from a bounded sample (``sample_rows``, by hash), refined with oversized lists split
until they are balanced. Every row is indexed: in the list of its nearest centroid, and, if it lies
near a boundary, in up to ``copies`` lists whose centroids are within ``edge`` times that distance. A
query walks a neighbour graph over the centroids, held in memory, and reads the lists whose distance
is within ``reach`` times the nearest one's, ``probes`` at most of those found; but the nearest eight at
least, and so many that they are home to ``k`` other rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.common import cut
from tarnwork.llm.vectors import QUERY, best, mark, matrix, packed, same_width, unpacked, usable


def cluster(x: np.ndarray, lists: int, seed: int = 7, rounds: int = 8) -> np.ndarray:
    """Centroids of about ``lists`` balanced clusters of the sample: lists over twice the mean are split."""
    draw = np.random.default_rng(seed)
    lists = max(1, min(lists, len(x)))
    c = x[np.sort(draw.choice(len(x), lists, replace=False))]
    for turn in range(rounds):
        near = assign(x, c)
        count = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = total[count > 0] / count[count > 0, None]
        count = count[count > 0]
        if turn < rounds - 1:
            large = np.flatnonzero(count > 2 * len(x) / lists)
            noise = draw.normal(scale=1e-2, size=(len(large), c.shape[1])) * (np.linalg.norm(c[large], axis=1)[:, None] + 1e-9)
            c = np.concatenate([c, c[large] + noise])
    return c


def assign(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (c**2).sum(axis=1) / 2
    for lo in range(0, len(x), 2048):
        out[lo : lo + 2048] = np.argmax(x[lo : lo + 2048] @ c.T - half, axis=1)
    return out


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1), 0))


#: Nearest lists that a query reads whatever their distances.
_LEAST = 8


def chosen(q: np.ndarray, c: np.ndarray, found: np.ndarray, d: np.ndarray, reach: float, homes: np.ndarray, need: int) -> np.ndarray:
    """The lists that a query reads of those found, nearest first: within reach, ``_LEAST`` at least, and until
    they are home to ``need`` rows; all lists by distance where those found aren't. ``homes``: rows whose nearest
    centroid it is, by list, so that none counts twice."""
    within = max(int((d <= max(d[0], 1e-12) * reach).sum()), min(_LEAST, len(found)))
    if homes[found[:within]].sum() >= need:
        return found[:within]
    if homes[found].sum() < need:
        rest = np.argsort(((c - q) ** 2).sum(axis=1), kind="stable")
        found = np.concatenate([found, rest[~np.isin(rest, found)]])
    return found[: max(within, int(np.searchsorted(np.cumsum(homes[found]), need)) + 1)]


class Graph:
    """Neighbour graph over the centroids, searched best first. Links go both ways and every part of it has an entry, so
    that a walk can reach all centroids: those far out are nearest to none, and clusters lie apart."""

    def __init__(self, c: np.ndarray, degree: int = 24):
        self.c = c
        degree = min(degree, max(len(c) - 1, 0))
        near = np.argsort(distances(c, c), axis=1, kind="stable")[:, 1 : degree + 1]
        ends = np.unique(np.concatenate([np.stack([np.repeat(np.arange(len(c)), degree), near.ravel()], axis=1), np.stack([near.ravel(), np.repeat(np.arange(len(c)), degree)], axis=1)]), axis=0)
        self.links = np.split(ends[:, 1], np.searchsorted(ends[:, 0], np.arange(1, len(c))))
        # the starting points lie spread over the sample's order, with one at least in each part; the centroids of the longest
        # rows, which many queries want and few others are near, are among them
        long = np.argsort(-(c[:, :-1] ** 2).sum(axis=1), kind="stable")[:32]
        self.entry = np.unique(np.concatenate([np.linspace(0, len(c) - 1, min(len(c), 16)).astype(int), long, self._parts()]))

    def _parts(self) -> np.ndarray:
        """The first centroid of each connected part."""
        seen, out = np.zeros(len(self.c), bool), []
        for i in range(len(self.c)):
            if not seen[i]:
                out.append(i)
                seen[i], todo = True, [i]
                while todo:
                    new = self.links[todo.pop()]
                    new = new[~seen[new]]
                    seen[new] = True
                    todo.extend(new.tolist())
        return np.array(out, np.int64)

    def nearest(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest centroids that the walk finds, with distances."""
        gap = lambda at: np.sqrt(((self.c[at] - q) ** 2).sum(axis=1))
        seen = np.zeros(len(self.c), bool)
        seen[self.entry] = True
        d = gap(self.entry)
        todo = [(float(x), int(i)) for x, i in zip(d, self.entry)]
        heapq.heapify(todo)
        kept = [(-x, i) for x, i in todo]
        heapq.heapify(kept)
        while len(kept) > width:
            heapq.heappop(kept)
        while todo:
            x, i = heapq.heappop(todo)
            if len(kept) >= width and x > -kept[0][0]:
                break
            new = self.links[i][~seen[self.links[i]]]
            if not len(new):
                continue
            seen[new] = True
            for y, j in zip(gap(new).tolist(), new.tolist()):
                if len(kept) < width:
                    heapq.heappush(kept, (-y, j))
                elif y < -kept[0][0]:
                    heapq.heapreplace(kept, (-y, j))
                else:
                    continue
                heapq.heappush(todo, (y, j))
        kept.sort(reverse=True)
        return np.array([i for _, i in kept], np.int64), np.array([-x for x, _ in kept])


#: Found rows that a task holds before it drops those that are not among a query's best.
_HELD = 400_000


def _top_of_part(ids, x, qids, q, marks, k):
    """(query, mark, vec_id, score) of a part's best rows for each query, its own left out."""
    out = []
    for lo in range(0, len(qids), 256):
        part = q[lo : lo + 256]
        score = part @ x.T
        score[ids[None, :] == qids[lo : lo + 256, None]] = -np.inf
        bound = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k] if len(ids) > k else np.full((len(part), 1), -np.inf)
        # a product's last digits depend on the blocks' shapes: what is near the bound is added up in order
        slack = 1e-12 * (1 + np.abs(part).sum(axis=1, keepdims=True) * np.abs(x).max(initial=0))
        query, row = np.nonzero((score >= bound - slack) & (score > -np.inf))
        exact = np.zeros(len(query))
        for d in range(x.shape[1]):
            exact += part[query, d] * x[row, d]
        out.append((qids[lo + query], marks[lo + query], ids[row], exact))
    return _top_of_queries(out, k) if out else (qids[:0], marks[:0], ids[:0], np.zeros(0))


def _top_of_queries(found, k):
    qids, marks, ids, score = (np.concatenate([f[c] for f in found]) for c in range(4))
    order = np.lexsort((ids, -score, marks, qids))
    qids, marks, ids, score = qids[order], marks[order], ids[order], score[order]
    if not len(qids):
        return qids, marks, ids, score
    new = np.concatenate([[True], (qids[1:] != qids[:-1]) | (marks[1:] != marks[:-1])])
    once = new | np.concatenate([[True], (ids[1:] != ids[:-1]) | (score[1:] != score[:-1])])
    qids, marks, ids, score, new = qids[once], marks[once], ids[once], score[once], new[once]
    first = np.flatnonzero(new)
    rank = np.arange(len(qids)) - np.repeat(first, np.diff(np.append(first, len(qids))))
    return tuple(c[rank < k] for c in (qids, marks, ids, score))


def nearest_vectors(
    vectors: DataFrame,
    k: int = 20,
    queries: str = QUERY,
    list_rows: int = 512,
    most_lists: int = 4096,
    sample_rows: int = 20_000,
    edge: float = 1.05,
    copies: int = 2,
    reach: float = 1.25,
    probes: int | None = None,
    part_rows: int = 2048,
) -> DataFrame:
    """The ``k`` nearest found of each query vector over all other rows, by largest inner product.

    Returns query_id, rank, vec_id, score (double precision, on the original vectors). Left out are
    rows without vec_id and vectors that are null, zero or hold null or non-finite components; shorter
    vectors are filled with zeros. Equal rows count once; rows that share a query's vec_id are its own.
    Vectors of unequal lengths are told apart by one more component, and queries are brought to the largest length, which
    makes the largest inner product the least distance. Lists number rows / ``list_rows``, ``most_lists`` at most;
    beyond that they grow, and no row is left out. ``probes`` is three fifths of them unless given; with an infinite
    ``reach`` and as many probes as lists the search is exact. A list of many rows is searched in parts.
    """
    rows = usable(vectors).filter(F.exists("v", lambda x: x != 0))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    rows = cut(rows.withColumn("s", square))
    n, top, width = rows.agg(F.count(F.lit(1)), F.max("s"), F.max(F.size("v"))).first()
    if not n:
        return best(rows.select(F.col("vec_id").alias("query_id"), F.lit(0).cast("long").alias("mark"), "vec_id", F.col("s").alias("score")), k)
    lists = max(1, min(most_lists, n // list_rows))

    def lift(v: np.ndarray, s: np.ndarray | None) -> np.ndarray:
        """One more component: what is missing to the largest length. Queries, which have none, are brought to that length,
        so that rows and queries lie on one sphere and distances tell inner products whatever a query's own length."""
        v = np.pad(v, ((0, 0), (0, width - v.shape[1])))
        if s is None:
            # by the largest component first, so that no square overflows or vanishes
            v = v / np.abs(v).max(axis=1, keepdims=True)
            v = v * (np.sqrt(top) / np.sqrt((v**2).sum(axis=1)))[:, None]
        return np.column_stack([v, np.zeros(len(v)) if s is None else np.sqrt(np.maximum(top - s, 0))])

    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(sample_rows).select("vec_id", "v", "s").toArrow().sort_by([("vec_id", "ascending")])
    c = cluster(lift(matrix(sample.column("v")), sample.column("s").to_numpy()), lists)
    take = min(len(c), probes or max(8, -(-3 * len(c) // 5)))

    def file(it):
        for batch in it:
            x = lift(matrix(batch.column("v")), batch.column("s").to_numpy(zero_copy_only=False))
            for lo in range(0, len(x), 2048):
                d = distances(x[lo : lo + 2048], c)
                near = np.argsort(d, axis=1, kind="stable")[:, :copies]
                d = np.take_along_axis(d, near, axis=1)
                at, col = np.nonzero(d <= d[:, :1] * edge)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(near[at, col].astype(np.int32)), batch.column("vec_id").take(pa.array(at + lo)), batch.column("v").take(pa.array(at + lo)), pa.array(col == 0)], names=["list", "vec_id", "v", "home"]
                )

    def ask(it):
        graph = Graph(c)
        for batch in it:
            q = lift(matrix(batch.column("v")), None)
            at, lists_of = [], []
            for i, (one, own) in enumerate(zip(q, batch.column("own").to_pylist())):
                found = chosen(one, c, *graph.nearest(one, take), reach, homes, k + own)
                at.append(np.full(len(found), i)), lists_of.append(found)
            at = pa.array(np.concatenate(at) if at else np.zeros(0, np.int64))
            lists_of = pa.array(np.concatenate(lists_of).astype(np.int32) if len(lists_of) else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([lists_of, batch.column("vec_id").take(at), batch.column("v").take(at)], names=["list", "vec_id", "v"])

    kind = "list int, vec_id long, v array<double>"

    def in_parts(filed: DataFrame, seed: int) -> DataFrame:
        """Packs each list, in parts of about ``part_rows`` rows."""
        # a list's parts go by its count; there are at most ``most_lists`` lists or so
        parts = filed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts"))
        filed = filed.join(F.broadcast(parts), "list")
        filed = filed.withColumn("part", F.pmod(F.xxhash64("vec_id", "v", F.lit(seed)), F.col("parts")).cast("int"))
        return packed(filed.select("list", "part", "vec_id", "v"), "list", "part")

    filed = cut(rows.select("vec_id", "v", "s").mapInArrow(file, kind + ", home boolean"))
    homes = np.zeros(len(c), np.int64)
    for r in filed.filter("home").groupBy("list").count().collect():
        homes[r["list"]] = r["count"]
    index = in_parts(filed.drop("home"), 1)
    asking = rows.filter(queries).select("vec_id", "v")
    # rows that share a query's vec_id are none of its neighbours
    asking = asking.join(asking.groupBy("vec_id").agg(F.count(F.lit(1)).alias("own")), "vec_id")
    asked = in_parts(cut(asking.mapInArrow(ask, kind)), 2)
    asked = asked.select("list", F.col("part").alias("qpart"), *[F.col(x).alias(f"q{x}") for x in ("n", "width", "ids", "data")])

    def search(it):
        held, size = [], 0
        for batch in it:
            for i in range(batch.num_rows):
                ids, x = unpacked(batch, i, "")
                qids, q = unpacked(batch, i, "q")
                x, q = same_width(x, q)
                held.append(_top_of_part(ids, x, qids, q, mark(q), k))
                size += len(held[-1][0])
                if size > _HELD:
                    held = [_top_of_queries(held, k)]
                    size = 0
        if held:
            qids, marks, ids, score = _top_of_queries(held, k)
            yield pa.RecordBatch.from_arrays([pa.array(qids), pa.array(marks), pa.array(ids), pa.array(score)], names=["query_id", "mark", "vec_id", "score"])

    partial = index.join(asked, "list").mapInArrow(search, "query_id long, mark long, vec_id long, score double")
    # a row found in several lists counts once; different vectors of one vec_id differ in score
    return best(partial.distinct(), k)


#: The exact search, which small tables get: they have few lists, all of which are read.
SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]), lambda a, b: a + b) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
