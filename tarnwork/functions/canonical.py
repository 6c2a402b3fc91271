"""Documents as pointers and values, canonical numbers, and differences between documents."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLAT = "id string, pointer string, kind string, value string"


def canonical(x):
    """Whole floats below 2**53 as integers; -0.0 and what isn't finite stay; truth values are no numbers."""
    if isinstance(x, float) and math.isfinite(x) and x == int(x) and abs(x) < 2**53 and not (x == 0 and math.copysign(1, x) < 0):
        return int(x)
    if isinstance(x, dict):
        return {k: canonical(v) for k, v in x.items()}
    return [canonical(v) for v in x] if isinstance(x, list) else x


def leaves(x, at: str = ""):
    """(pointer, kind, value) of every leaf; an empty object or array is a leaf, an array tells its length too."""
    if isinstance(x, dict):
        if not x:
            yield at, "object", "{}"
        for k, v in x.items():
            yield from leaves(v, f"{at}/{k.replace('~', '~0').replace('/', '~1')}")
    elif isinstance(x, list):
        yield f"{at}/#", "length", str(len(x))
        for i, v in enumerate(x):
            yield from leaves(v, f"{at}/{i}")
    else:
        kind = "null" if x is None else "boolean" if isinstance(x, bool) else "string" if isinstance(x, str) else "number"
        yield at, kind, x if isinstance(x, str) else json.dumps(x)


def flatten_documents(docs: DataFrame) -> DataFrame:
    """Leaves of documents (id, raw); a document that isn't JSON, or nests too deep to be read, has one leaf of kind invalid."""

    def flat(it: Iterator[pa.RecordBatch]):
        for batch in it:
            rows = []
            for i, raw in zip(batch.column("id").to_pylist(), batch.column("raw").to_pylist()):
                try:
                    rows += [(i, *leaf) for leaf in leaves(canonical(json.loads(raw if raw is not None else "")))]
                except (ValueError, RecursionError):
                    rows.append((i, "", "invalid", raw))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)], names=["id", "pointer", "kind", "value"])

    return docs.select(F.col("id").cast("string").alias("id"), "raw").mapInArrow(flat, FLAT)


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, pointer, change) of the leaves that were added, lost or changed between two tables of documents."""
    a = flatten_documents(before).select("id", "pointer", F.struct("kind", "value").alias("_a"))
    b = flatten_documents(after).select("id", "pointer", F.struct("kind", "value").alias("_b"))
    both = a.join(b, ["id", "pointer"], "full_outer").filter("NOT (_a <=> _b)")
    return both.select("id", "pointer", F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "lost").otherwise("changed").alias("change"))
