"""Stable identities of findings.

A finding is a row (path, run_index, result_index, scope, rule_id, uri, start_line, start_column, snippet,
partial_fps map, fps map); all but the indexes may be null. ``path`` names the log that the finding is from;
a table without it is one log. Runs of different logs are different runs, whatever their numbers.
"""

from __future__ import annotations

import unicodedata
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Format constant of the digest; identities of different versions never meet.
VERSION = "findings/v1"
LINE_HASH = "primaryLocationLineHash"
NUL = "\0"


def digest(*parts: Column) -> Column:
    """First 32 hex digits of the SHA-256 of the parts joined by NUL; null parts are empty."""
    return F.substring(F.sha2(F.concat_ws(NUL, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 32)


def normalize_line(line: Column) -> Column:
    """Trailing white space of any script goes, leading stays."""
    return F.regexp_replace(line, r"(?U)\s+$", "")


@F.pandas_udf(T.StringType())
def normalize_path(uri: pd.Series) -> pd.Series:
    """Percent escapes decoded (bad ones stay), backslashes turned, leading ./ dropped, NFC."""

    def one(x):
        if x is None:
            return None
        x = unquote(x).replace("\\", "/")
        while x.startswith("./"):
            x = x[2:]
        return unicodedata.normalize("NFC", x)

    return uri.map(one, na_action="ignore")


def plain_path(uri: Column) -> Column:
    """``normalize_path`` for paths in ASCII without escapes, inside the JVM."""
    return F.regexp_replace(F.translate(uri, "\\", "/"), r"^(\./)+", "")


def path_of(uri: Column) -> Column:
    """The normal path; Python sees only the paths that need it."""
    simple = uri.rlike(r"^[\x00-\x24\x26-\x7F]*$")
    return F.when(simple, plain_path(uri)).otherwise(normalize_path(uri))


def run_keys(findings: DataFrame) -> list[str]:
    """Columns that tell a run."""
    return [c for c in ("path", "run_index") if c in findings.columns]


def degenerate(findings: DataFrame) -> DataFrame:
    """(path, run_index, value) of fingerprints that sit at two or more places of one run, a place being (rule, uri, line)."""
    run = run_keys(findings)
    place = F.struct("rule_id", "uri", "start_line").alias("place")
    values = F.concat(F.coalesce(F.map_values("partial_fps"), F.array().cast("array<string>")), F.coalesce(F.map_values("fps"), F.array().cast("array<string>")))
    seen = findings.select(*run, F.explode(values).alias("value"), place)
    # distinct places first: a placeholder on every finding doesn't become one group of all rows
    return seen.distinct().groupBy(*run, "value").agg(F.count(F.lit(1)).alias("places")).filter("places > 1").select(*run, "value")


def correlate(findings: DataFrame, version: str = VERSION) -> DataFrame:
    """Adds correlation_id and identity_source, by the first usable of line hash, tool fingerprint, content, position."""
    values = F.map_concat(F.coalesce("fps", F.create_map().cast("map<string,string>")), F.when(F.element_at("partial_fps", LINE_HASH).isNotNull(), F.create_map(F.lit("\0line"), F.element_at("partial_fps", LINE_HASH))).otherwise(F.create_map().cast("map<string,string>")))
    bad = degenerate(findings).withColumn("_bad", F.lit(True))
    run = run_keys(findings)
    keyed = findings.select(*run, "result_index", F.explode(values).alias("_k", "_v"))
    same = lambda a, b, names: reduce(Column.__and__, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names])
    # a placeholder on many findings makes this key hot: the few bad values go to all tasks if they are few, else skew is split
    keyed = keyed.alias("k").join(bad.withColumnRenamed("value", "_v").alias("b"), same("k", "b", [*run, "_v"]), "left").filter("_bad IS NULL").select("k.*")
    usable = keyed.groupBy(*run, "result_index").agg(
        F.max(F.when(F.col("_k") == "\0line", F.col("_v"))).alias("_line"), F.min(F.when(F.col("_k") != "\0line", F.struct("_k", "_v"))).alias("_tool")
    )
    rows = findings.alias("f").join(usable.alias("u"), same("f", "u", [*run, "result_index"]), "left").select("f.*", "u._line", "u._tool")
    line = F.when(F.col("_line") != "", F.col("_line"))
    number = F.when(F.col("start_line") != 0, F.col("start_line").cast("string"))
    column = F.when(F.col("start_column") != 0, F.col("start_column").cast("string"))
    path = F.coalesce(path_of(F.col("uri")), F.lit(""))
    head = [F.lit(version), F.col("scope"), F.col("rule_id")]
    rows = rows.withColumn("_path", path)
    cid = (
        F.when(line.isNotNull(), digest(*head, F.col("_path"), column, line))
        .when(F.col("_tool").isNotNull(), digest(*head, F.col("_path"), column, F.col("_tool._k"), F.col("_tool._v")))
        .when(F.col("snippet").isNotNull(), digest(*head, F.col("_path"), column, normalize_line(F.col("snippet"))))
        .otherwise(digest(*head, F.col("_path"), number, column))
    )
    source = F.when(line.isNotNull(), LINE_HASH).when(F.col("_tool").isNotNull(), "toolFingerprint").when(F.col("snippet").isNotNull(), "content").otherwise("positional")
    return rows.withColumns({"correlation_id": cid, "identity_source": source}).drop("_line", "_tool", "_path")


def tell_apart(refs: DataFrame) -> DataFrame:
    """Findings of one run and identity at several lines get :1, :2, ... from the second line on."""
    w = Window.partitionBy(*run_keys(refs), "correlation_id").orderBy(F.col("start_line").asc_nulls_last())
    n = F.dense_rank().over(w) - 1
    return refs.withColumn("correlation_id", F.when(n > 0, F.concat("correlation_id", F.lit(":"), n.cast("string"))).otherwise(F.col("correlation_id")))
