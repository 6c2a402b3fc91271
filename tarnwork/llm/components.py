"""Connected components: tasks unite the edges that they hold, and large and small stars unite the tasks' results."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.common import cut


#: Edges that a task should hold about.
EDGES = 100_000


def _unite(it):
    """A star for each component of a task's own edges: (u, v) with v the least node."""
    batches = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in it]
    ends = np.stack([np.concatenate(x) for x in zip(*batches)]) if batches else np.zeros((2, 0), np.int64)
    nodes, at = np.unique(ends, return_inverse=True)
    at = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[at[0]], root[at[1]])
        new = root.copy()
        # both ends' present roots take the least of the two
        np.minimum.at(new, root[at[0]], low)
        np.minimum.at(new, root[at[1]], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    low = nodes[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes[nodes != low].astype(np.int64)), pa.array(low[nodes != low].astype(np.int64))], names=["u", "v"])


def _least(pairs: DataFrame, own: bool) -> DataFrame:
    low = F.min("v")
    return pairs.groupBy("u").agg((F.least(F.col("u"), low) if own else low).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    out = both.filter("v > u").join(_least(both, True), "u")
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = _least(edges, False)
    out = edges.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that an edge (u, v) of longs names, root being the least node of its component.

    Loops and repeated edges do no harm. Each round is checkpointed; the rounds end when the edges
    are stars and stay as they are. The same steps serve every size; a task holds about ``EDGES`` edges.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v")
    edges, state = cut(edges), None
    while True:
        # a round's end is told by the edges' count and checksum: a star forest stays as it is
        now = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == state or not now[0]:
            break
        state = now
        # few edges need few tasks; each brings its own edges down to stars first
        edges = edges.coalesce(1 + now[0] // EDGES).mapInArrow(_unite, "u long, v long")
        edges = cut(_small_star(_large_star(edges)))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
