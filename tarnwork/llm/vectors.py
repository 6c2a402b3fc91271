"""Vectors in packed blocks, and the choice of the best rows of each query."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY = "vec_id % 20 = 0"


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Distinct (vec_id, v) of vectors without null or non-finite components; other columns don't matter."""
    v = F.col(column).cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return rows.distinct()


def matrix(column) -> np.ndarray:
    """Rows of a list column as one array; shorter ones are filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), int(size.max(initial=0))))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def packed(rows: DataFrame, *keys: str) -> DataFrame:
    """A row (keys, n, width, ids, data) for each group of keys, its vectors by vec_id."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("vec_id", "ascending")])
        m = matrix(table.column("v"))
        return pa.table(
            {k: table.column(k)[:1] for k in keys}
            | {"n": pa.array([len(m)]), "width": pa.array([m.shape[1]]), "ids": pa.array([table.column("vec_id").to_numpy().tobytes()], pa.binary()), "data": pa.array([m.tobytes()], pa.binary())}
        )

    kinds = dict(rows.dtypes)
    return rows.groupBy(*keys).applyInArrow(pack, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n long, width long, ids binary, data binary")


def unpacked(batch: pa.RecordBatch, i: int, side: str) -> tuple[np.ndarray, np.ndarray]:
    get = lambda name: batch.column(side + name)[i].as_py()
    return np.frombuffer(get("ids"), np.int64), np.frombuffer(get("data")).reshape(get("n"), get("width"))


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = max(a.shape[1], b.shape[1])
    return tuple(x if x.shape[1] == w else np.pad(x, ((0, 0), (0, w - x.shape[1]))) for x in (a, b))


def mark(v: np.ndarray) -> np.ndarray:
    """Tells the query rows of one vec_id apart by content."""
    from tarnwork.llm.bytesops import U64, mix

    h = np.zeros(len(v), U64)
    for k in range(v.shape[1]):
        x = np.ascontiguousarray(v[:, k] + 0.0).view(U64)
        h = np.where(v[:, k] != 0, h + mix(x, k), h)
    return h.view(np.int64)


def best(partial: DataFrame, k: int, keep: tuple = ()) -> DataFrame:
    """Of (query_id, mark, vec_id, score) the ``k`` highest scores of each query, ties to smaller vec_id."""
    w = Window.partitionBy("query_id", "mark").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = partial.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", *keep)
