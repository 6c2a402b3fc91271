"""Exact top-k search by inner product over a bit-sliced index.

Rows are held in blocks; of each block, every component is sliced into bitmaps over its rows, one for
each binary digit. A query's scores are added up by bitmap arithmetic alone (carry-save adders over
the slices, for many queries side by side), giving the scores' own slices. The top rows are then
selected from the most significant slice downward, and the rows that tie at the boundary are resolved
exactly, by vec_id. The index is built once and holds the slices, an eighth of the vectors' size or so.

Slices and sums are held in longs. Vectors with a component so large that a sum might not fit (see NARROW)
are compared one by one in integers of any length, with all queries, and as queries with all rows.
"""

from __future__ import annotations

from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.llm import blocks as B
from tarnwork.llm.bytesops import U64
from tarnwork.llm.common import cut
from tarnwork.llm.vectors import QUERY, best, mark, matrix, packed, same_width, unpacked, usable

ALL = U64(2**64 - 1)
#: Quantised components up to this give sums that a long holds, whatever the vectors' length.
NARROW = 2**24
_SIDE = 128


class Slices:
    """The slices of a block's components, each less the component's least value in the block."""

    def __init__(self, x: np.ndarray):
        n, width = x.shape
        self.n, self.words = n, -(-n // 64)
        self.least = x.min(axis=0) if n else np.zeros(width, np.int64)
        y = (x - self.least).astype(U64)
        self.digits = [int(y[:, d].max(initial=0)).bit_length() for d in range(width)]
        self.maps = [[_bitmap(y[:, d] >> U64(b) & U64(1), self.words) for b in range(self.digits[d])] for d in range(width)]


    def dump(self) -> bytes:
        flat = b"".join(m.tobytes() for maps in self.maps for m in maps)
        return B.put_ints((np.array([self.n]), False), (self.least.view(U64), False), (np.array(self.digits), False), tail=flat)

    @classmethod
    def load(cls, data: bytes) -> Slices:
        (n,), least, digits, flat = B.get_ints(data, tail=True)
        s = cls.__new__(cls)
        s.n, s.words, s.least, s.digits = int(n), -(-int(n) // 64), least.view(np.int64), digits.astype(int).tolist()
        rows = iter(np.frombuffer(flat, U64).reshape(-1, s.words) if s.words else [])
        s.maps = [[next(rows) for _ in range(d)] for d in s.digits]
        return s

    def values(self) -> np.ndarray:
        """The components again, rows by width."""
        out = np.repeat(self.least[None, :], self.n, axis=0)
        for d, maps in enumerate(self.maps):
            for b, m in enumerate(maps):
                out[:, d] += np.unpackbits(m.view(np.uint8), bitorder="little")[: self.n].astype(np.int64) << b
        return out


def _bitmap(bits: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(words * 64, np.uint8)
    out[: len(bits)] = bits
    return np.packbits(out, bitorder="little").view(U64)


def add_up(s: Slices, q: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Slices, least significant first, of the queries' scores less a constant of each query; and the constants.

    A negative factor counts the complement of the component's slices instead.
    """
    waiting: dict[int, list[np.ndarray]] = {}

    def add(plane: np.ndarray, weight: int):
        while True:
            have = waiting.setdefault(weight, [])
            have.append(plane)
            if len(have) < 3:
                return
            c, b, a = have.pop(), have.pop(), have.pop()
            half = a ^ b
            have.append(half ^ c)
            plane, weight = (a & b) | (half & c), weight + 1

    size = np.abs(q)
    constant = q @ s.least
    for d, maps in enumerate(s.maps):
        if not maps or not size[:, d].any():
            continue
        negative = np.where(q[:, d] < 0, ALL, U64(0))[:, None]
        constant += np.where(q[:, d] < 0, q[:, d] * ((1 << s.digits[d]) - 1), 0)
        flipped = [m[None, :] ^ negative for m in maps]
        for j in range(int(size[:, d].max()).bit_length()):
            on = np.where((size[:, d] >> j) & 1, ALL, U64(0))[:, None]
            if on.any():
                for b, m in enumerate(flipped):
                    add(m & on, b + j)
    planes = []
    weight = 0
    while waiting:
        have = waiting.pop(weight, [])
        while len(have) > 1:
            b, a = have.pop(), have.pop()
            if have:
                c = have.pop()
                half = a ^ b
                have.append(half ^ c)
                waiting.setdefault(weight + 1, []).append((a & b) | (half & c))
            else:
                have.append(a ^ b)
                waiting.setdefault(weight + 1, []).append(a & b)
        planes.append(have[0] if have else np.zeros((len(q), s.words), U64))
        weight += 1
    return planes, constant


def select(planes: list[np.ndarray], allowed: np.ndarray, k: int) -> np.ndarray:
    """Bitmap of the ``k`` highest rows of each query; of equal ones the first."""
    sure, open_ = np.zeros_like(allowed), allowed.copy()
    count = lambda x: np.bitwise_count(x).sum(axis=1, dtype=np.int64)
    for p in reversed(planes):
        both = sure | (open_ & p)
        n = count(both)[:, None]
        more, fewer = n > k, n <= k
        sure = np.where(fewer, both, sure)
        open_ = np.where(more, open_ & p, open_ & ~p)
    need = k - count(sure)
    bits = np.unpackbits(open_.view(np.uint8), axis=1, bitorder="little")
    first = (np.cumsum(bits, axis=1, dtype=np.int32) <= need[:, None]) & (bits > 0)
    return sure | np.packbits(first, axis=1, bitorder="little").view(U64)


def search_block(ids: np.ndarray, x: np.ndarray, s: Slices, qids: np.ndarray, q: np.ndarray, k: int):
    """(query index, row index, score) of the block's best rows for each query, its own row left out."""
    planes, _ = add_up(s, q)
    full = _bitmap(np.ones(len(ids), np.uint8), s.words)
    allowed = np.repeat(full[None, :], len(q), axis=0)
    lo, hi = np.searchsorted(ids, qids), np.searchsorted(ids, qids, side="right")
    for i in np.flatnonzero(hi > lo):
        for at in range(lo[i], hi[i]):
            allowed[i, at >> 6] &= ~(U64(1) << U64(at & 63))
    found = select(planes, allowed, k)
    query, row = np.nonzero(np.unpackbits(found.view(np.uint8), axis=1, bitorder="little"))
    return query, row, np.einsum("ij,ij->i", q[query], x[row])


def _sliced(rows: DataFrame, key: str) -> DataFrame:
    """A row (key, ids, slices) for each group of rows."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by([("vec_id", "ascending")])
        x = np.floor(matrix(table.column("v"))).astype(np.int64)
        return pa.table({key: table.column(key)[:1], "ids": pa.array([table.column("vec_id").to_numpy().tobytes()], pa.binary()), "slices": pa.array([Slices(x).dump()], pa.binary())})

    return rows.groupBy(key).applyInArrow(build, f"{key} int, ids binary, slices binary")


def _integers(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) in integers of any length."""
    whole = lambda v: floor(v * scale) if abs(v * scale) < 2**60 else floor(Fraction(v) * Fraction(scale))
    return np.array([[whole(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def _one_by_one(rows: DataFrame, asked: DataFrame, k: int, scale: float, row_groups: int, query_groups: int) -> DataFrame:
    """(query_id, mark, vec_id, score as text) of the best rows of each query in each group of rows, by long integers."""
    place = lambda parts, seed: F.pmod(F.xxhash64("vec_id", "v", F.lit(seed)), F.lit(parts)).cast("int")
    index = packed(rows.withColumn("r", place(row_groups, 1)), "r").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(query_groups - 1))))
    queries = packed(asked.withColumn("g", place(query_groups, 2)), "g").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(row_groups - 1))))
    queries = queries.select("g", "r", *[F.col(c).alias(f"q{c}") for c in ("n", "width", "ids", "data")])

    def search(it):
        for batch in it:
            for i in range(batch.num_rows):
                ids, x = unpacked(batch, i, "")
                qids, q = unpacked(batch, i, "q")
                x, q = same_width(x, q)
                long_x, marks, out = _integers(x, scale), mark(q), []
                for n, (qid, one) in enumerate(zip(qids.tolist(), _integers(q, scale))):
                    scores = (long_x @ one).tolist() if len(one) else [0] * len(ids)
                    best_rows = sorted((-s, v) for s, v in zip(scores, ids.tolist()) if v != qid)[:k]
                    out += [(qid, int(marks[n]), v, str(-s)) for s, v in best_rows]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate(kinds)], names=["query_id", "mark", "vec_id", "score"])

    return index.join(queries, ["g", "r"]).mapInArrow(search, "query_id long, mark long, vec_id long, score string")


def exact_top(vectors: DataFrame, k: int = 20, scale: float = 64.0, queries: str = QUERY, rows: int = 4096, query_rows: int = 512) -> DataFrame:
    """The ``k`` highest integer inner products of each query vector over all other rows.

    Components count as floor(scale * x). Returns query_id, rank, vec_id, score. Left out are rows
    without vec_id and vectors that are null or hold null or non-finite components; shorter vectors are
    filled with zeros. Equal rows count once; rows that share a query's vec_id are its own; several
    different vectors of one vec_id are searched and found each. Components of any size are ranked by
    their exact products; a score beyond a long is returned as the long next to it. An empty table gives
    an empty result; other columns, of any name, don't matter.
    """
    fits = F.forall("v", lambda x: F.abs(x * F.lit(scale)) <= NARROW)
    whole = cut(usable(vectors).withColumn("fits", fits))
    quantised = F.transform("v", lambda x: F.floor(x * F.lit(scale)).cast("double"))
    narrow = cut(whole.filter("fits").select("vec_id", quantised.alias("v")).distinct())
    n, m = narrow.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.expr(queries).cast("long")), F.lit(0))).first()
    many, sides = max(1, -(-n // rows)), max(1, -(-m // query_rows))
    place = lambda parts, seed: F.pmod(F.xxhash64("vec_id", "v", F.lit(seed)), F.lit(parts)).cast("int")
    index = cut(_sliced(narrow.withColumn("r", place(many, 1)), "r")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
    asked = packed(narrow.filter(queries).withColumn("g", place(sides, 2)), "g").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    asked = asked.select("g", "r", *[F.col(c).alias(f"q{c}") for c in ("n", "width", "ids", "data")])

    def search(it):
        for batch in it:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[i].as_py(), np.int64)
                s = Slices.load(batch.column("slices")[i].as_py())
                qids, q = unpacked(batch, i, "q")
                marks, q = mark(q), q.astype(np.int64)
                x = s.values()
                wide = max(x.shape[1], q.shape[1])
                s.least, s.digits, s.maps = np.pad(s.least, (0, wide - x.shape[1])), s.digits + [0] * (wide - x.shape[1]), s.maps + [[]] * (wide - x.shape[1])
                x, q = same_width(x, q)
                for lo in range(0, len(qids), _SIDE):
                    hi = lo + _SIDE
                    query, row, score = search_block(ids, x, s, qids[lo:hi], q[lo:hi], k)
                    yield pa.RecordBatch.from_arrays([pa.array(qids[lo:hi][query]), pa.array(marks[lo:hi][query]), pa.array(ids[row]), pa.array(score)], names=["query_id", "mark", "vec_id", "score"])

    partial = index.join(asked, ["g", "r"]).mapInArrow(search, "query_id long, mark long, vec_id long, score long")
    large = whole.filter("NOT fits").select("vec_id", "v")
    if large.isEmpty():
        return best(partial, k)
    # narrow queries meet large rows, large queries meet all; narrow vectors are quantised already, so each side is given as it was
    plain = whole.select("vec_id", "v")
    count = lambda d: max(1, -(-d.count() // 1024))
    all_asked, large_asked = plain.filter(queries), large.filter(queries)
    small_asked = whole.filter("fits").select("vec_id", "v").filter(queries)
    one = _one_by_one(large, small_asked, k, scale, count(large), count(small_asked))
    two = _one_by_one(plain, large_asked, k, scale, count(plain), count(large_asked))
    # a narrow query is told by its quantised vector on one side and by its own on the other: both have one mark
    names = small_asked.select("vec_id", F.col("v").alias("v"), quantised.alias("quantised")).mapInArrow(_marks, "query_id long, own long, mark long")
    one = one.withColumnRenamed("mark", "own").join(names, ["query_id", "own"]).select("query_id", "mark", "vec_id", "score").distinct()
    every = best(partial, k, keep=("mark",)).select("query_id", "mark", "vec_id", F.col("score").cast("string").alias("score")).unionByName(one).unionByName(two.distinct())
    below, digits = F.col("score").startswith("-"), F.length("score")
    order = [below.asc(), F.when(below, -digits).otherwise(digits).desc(), F.when(~below, F.col("score")).desc(), F.when(below, F.col("score")).asc(), F.col("vec_id")]
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "mark").orderBy(*order))).filter(F.col("rank") <= k)
    edge = F.when(below, F.lit(-(2**63))).otherwise(F.lit(2**63 - 1))
    return ranked.select("query_id", "rank", "vec_id", F.coalesce(F.col("score").try_cast("bigint"), edge).alias("score"))


def _marks(it):
    for batch in it:
        own, quantised = (mark(matrix(batch.column(c))) for c in ("v", "quantised"))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(own), pa.array(quantised)], names=["query_id", "own", "mark"])


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
