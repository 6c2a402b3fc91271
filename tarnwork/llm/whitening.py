"""Whitening of embeddings by a tiled covariance.

Vectors are cut into blocks of rows, and these into blocks of columns, placed by row-block. Pairs of
dimensions belong to tiles: two column blocks of one row-block give a tile's product, the products are added
up by tile, first within a task. Only the finished tiles, which number by the dimensions, meet in
one matrix, whose eigenvectors whiten every row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.common import cut, partitions
from tarnwork.llm.vectors import matrix

#: Bytes of a block of rows, and of the tiles that a task adds up before it passes them on.
BLOCK, HELD = 2_000_000, 64_000_000
#: Components are taken to whole numbers; what leaves this range is moved to its edge, as a long can't hold it.
EDGE = 2**62


def remaining(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, v) of all rows whose vector is there and holds no null and no value that isn't finite."""
    v = F.col(column).cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("v IS NOT NULL")
    return rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def integers(v: np.ndarray, scale: float, shift: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = np.clip(np.floor(scale * v), -float(EDGE), float(EDGE) - 1024)
    return x.astype(np.int64) + shift


def column_blocks(rows: DataFrame, dims: int, tile: int, scale: float, shift: int) -> DataFrame:
    """(row_block, col, n, ids, data): longs, ``tile`` columns to a block, placed by row-block and checkpointed."""
    size = max(1, BLOCK // (8 * dims))

    def pack(it):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 24
        for batch in it:
            for lo in range(0, batch.num_rows, size):
                part = batch.slice(lo, size)
                # shorter vectors are filled with noughts
                x = matrix(part.column("v"))
                x = integers(np.pad(x, ((0, 0), (0, dims - x.shape[1]))), scale, shift)
                ids = part.column("vec_id")
                null = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                for col in range(0, dims, tile):
                    # the first column block carries the rows' ids
                    tag = np.stack([ids, null]).tobytes() if col == 0 else None
                    yield pa.RecordBatch.from_pydict(
                        {"row_block": pa.array([block]), "col": pa.array([col // tile], pa.int32()), "n": pa.array([len(x)]), "ids": pa.array([tag], pa.binary()), "data": pa.array([x[:, col : col + tile].tobytes()], pa.binary())}
                    )
                block += 1

    packed = rows.mapInArrow(pack, "row_block long, col int, n long, ids binary, data binary")
    return cut(packed.repartition(partitions(rows.sparkSession), "row_block").sortWithinPartitions("row_block"), placed=True)


def sums(blocks: DataFrame, dims: int, tile: int) -> tuple[int, list[int]]:
    """Number of rows, and the exact sum of every dimension."""

    def add(it):
        # halves of a long each, so that no sum of up to 2**31 rows overflows
        high, low, n = np.zeros(dims, np.int64), np.zeros(dims, np.int64), 0
        for batch in it:
            for col, rows, data in zip(*(batch.column(c).to_pylist() for c in ("col", "n", "data"))):
                x = np.frombuffer(data, np.int64).reshape(rows, -1)
                at = slice(col * tile, col * tile + x.shape[1])
                high[at] += (x >> 32).sum(axis=0)
                low[at] += (x & 0xFFFFFFFF).sum(axis=0)
                n += rows if col == 0 else 0
        yield pa.RecordBatch.from_pydict({"dim": pa.array(np.arange(-1, dims)), "high": pa.array(np.concatenate([[0], high])), "low": pa.array(np.concatenate([[n], low]))})

    wide = "decimal(38,0)"
    rows = blocks.select("col", "n", "data").mapInArrow(add, "dim long, high long, low long").groupBy("dim").agg(F.sum(F.col("high").cast(wide)).alias("high"), F.sum(F.col("low").cast(wide)).alias("low"))
    # a row for each dimension
    total = {r["dim"]: int(r["high"]) * 2**32 + int(r["low"]) for r in rows.collect()}
    return total.get(-1, 0), [total.get(d, 0) for d in range(dims)]


def centred(data: bytes, rows: int, mean: np.ndarray) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(rows, -1).astype(np.float64) - mean


def covariance(blocks: DataFrame, n: int, mean: np.ndarray, tile: int) -> np.ndarray:
    """Sums of products of centred columns over all rows, tile by tile, over ``n``."""
    dims = len(mean)

    def multiply(it):
        held: dict[tuple[int, int], np.ndarray] = {}
        size = 0
        for batch in it:
            for i, j, rows, a, b in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "n", "left", "right"))):
                product = centred(a, rows, mean[i * tile : (i + 1) * tile]).T @ centred(b, rows, mean[j * tile : (j + 1) * tile])
                if (i, j) in held:
                    held[i, j] += product
                else:
                    held[i, j] = product
                    size += product.nbytes
                if size > HELD:
                    yield from told(held)
                    held, size = {}, 0
        yield from told(held)

    def told(held):
        for (i, j), x in held.items():
            yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()), "data": pa.array([x.tobytes()], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        data = table.column("data")
        total = np.frombuffer(data[0].as_py()).copy()
        for k in range(1, len(data)):
            total += np.frombuffer(data[k].as_py())
        return pa.table({"i": table.column("i")[:1], "j": table.column("j")[:1], "data": pa.array([total.tobytes()], pa.binary())})

    left = blocks.select("row_block", F.col("col").alias("i"), "n", F.col("data").alias("left"))
    right = blocks.select(F.col("row_block").alias("_block"), F.col("col").alias("j"), F.col("data").alias("right"))
    # both sides are placed by row-block
    pairs = left.join(right, (F.col("row_block") == F.col("_block")) & (F.col("i") <= F.col("j"))).select("i", "j", "n", "left", "right")
    kind = "i int, j int, data binary"
    parts = pairs.mapInArrow(multiply, kind)
    # many tasks' sums of a tile are added in two steps, so that none gathers them all
    parts = parts.withColumn("_some", F.spark_partition_id() % 64)
    total = parts.groupBy("i", "j", "_some").applyInArrow(add, kind).groupBy("i", "j").applyInArrow(add, kind)
    out = np.zeros((dims, dims))
    for r in total.toLocalIterator():
        a, b = slice(r["i"] * tile, min(dims, (r["i"] + 1) * tile)), slice(r["j"] * tile, min(dims, (r["j"] + 1) * tile))
        out[a, b] = np.frombuffer(bytes(r["data"])).reshape(a.stop - a.start, b.stop - b.start) / n
        out[b, a] = out[a, b].T
    return out


def principal(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns; those without variance are left out."""
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    some = e[:most] > max(float(e[0]), 0.0) * 1e-12
    return e[:most][some], u[:, :most][:, some]


def deviations(x: np.ndarray, n: int, total: list[int], dims: int) -> np.ndarray:
    """Sum over the columns of (n * x - total) ** 2, as whole numbers; longs where the sum over ``dims`` columns fits."""
    mean = [s // n for s in total]
    # a bound in doubles, wide enough for its own rounding
    reach = max((max(int(x[:, k].max()) - m, m - int(x[:, k].min())) + 1 for k, m in enumerate(mean)), default=0) * n
    if reach * reach * dims < 2**62 and max(map(abs, total), default=0) < 2**62 and n * int(np.abs(x).max(initial=0)) < 2**62:
        d = n * x - np.array(total, np.int64)
        return (d * d).sum(axis=1)
    d = n * x.astype(object) - np.array(total, object)
    return (d * d).sum(axis=1)


def whiten(vectors: DataFrame, components: int = 8, tile: int = 32, scale: float = 1024.0, shift: int = 100_000, column: str = "embedding") -> DataFrame:
    """Every remaining row projected on the first principal components, over their standard deviations.

    Components x are floor(``scale`` * c) + ``shift``. Returns, for each row and component, vec_id, component, n, deviation
    (exact; beyond a long it is the largest one), whitened, explained and identity_error. Left out are rows whose
    vector is null or holds null or non-finite values; rows without vec_id or that repeat one count as any other. Shorter
    vectors are filled with noughts. Components without variance aren't returned, so rows that are all alike give
    none, as does an empty table; other columns, of any name, don't matter.
    """
    rows = remaining(vectors, column)
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0
    schema = "vec_id long, component int, n long, deviation long, whitened double"
    more = [("explained", "double"), ("identity_error", "double")]
    none = rows.sparkSession.createDataFrame([], schema + "".join(f", {c} {t}" for c, t in more))
    if not dims:
        return none
    tile = max(1, min(tile, dims))
    blocks = column_blocks(rows, dims, tile, scale, shift)
    n, total = sums(blocks, dims, tile)
    mean = np.array([s // n + (s % n) / n for s in total])
    v = covariance(blocks, n, mean, tile)
    e, u = principal(v, components)
    if not len(e):
        return none
    u = u / np.sqrt(e)

    def project(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A row-block's ids, which of them are null, deviations and whitened rows, from its column blocks."""
        out, deviation, tag = 0.0, 0, None
        for col, k, tagged, data in zip(*(table.column(c).to_pylist() for c in ("col", "n", "ids", "data"))):
            at = slice(col * tile, (col + 1) * tile)
            out = out + centred(data, k, mean[at]) @ u[at]
            deviation = deviation + deviations(np.frombuffer(data, np.int64).reshape(k, -1), n, total[at], dims)
            tag = tagged if tagged is not None else tag
        ids, null = np.frombuffer(tag, np.int64).reshape(2, -1)
        return ids, null.astype(bool), deviation, out

    def products(table: pa.Table) -> pa.Table:
        x = project(table)[3]
        i, j = np.triu_indices(len(e))
        return pa.table({"i": pa.array(i), "j": pa.array(j), "s": pa.array((x.T @ x)[i, j]), "at": pa.array(x.sum(axis=0)[i])})

    def finished(table: pa.Table) -> pa.Table:
        ids, null, deviation, x = project(table)
        deviation = np.minimum(deviation, 2**63 - 1).astype(np.int64)
        k = len(e)
        return pa.table(
            {
                "vec_id": pa.array(np.repeat(ids, k), mask=np.repeat(null, k)),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(ids))),
                "n": pa.array(np.full(len(ids) * k, n)),
                "deviation": pa.array(np.repeat(deviation, k)),
                "whitened": pa.array(x.ravel()),
            }
        )

    by_block = blocks.groupBy("row_block")
    second = by_block.applyInArrow(products, "i long, j long, s double, at double").groupBy("i", "j").agg(F.sum("s").alias("s"), F.sum("at").alias("at")).collect()
    first = {r["i"]: r["at"] / n for r in second}
    error = max(abs(r["s"] / n - first[r["i"]] * first[r["j"]] - (r["i"] == r["j"])) for r in second)
    share = F.element_at(F.array(*[F.lit(float(x)) for x in e / np.trace(v)]), F.col("component"))
    return by_block.applyInArrow(finished, schema).withColumn("explained", share).withColumn("identity_error", F.lit(float(error)))


def deviations_only(whitened: DataFrame) -> DataFrame:
    """The columns that SQL can state, one row for each vector."""
    return whitened.filter("component = 1").select("vec_id", "n", "deviation")


SQL = """
WITH x AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT) + 100000) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS (SELECT vec_id, unnest(x) AS x, unnest(range(1, len(x) + 1)) AS k FROM x),
s AS (SELECT k, count(*) AS n, CAST(sum(x) AS HUGEINT) AS s FROM p GROUP BY k)
SELECT vec_id, max(n) AS n, CAST(sum((n * x - s) * (n * x - s)) AS BIGINT) AS deviation FROM p JOIN s ON p.k = s.k GROUP BY vec_id
"""
