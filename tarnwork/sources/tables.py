"""Labelled data and run rows in JSON lines."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRIES = "id string, rule_id string, path string, line int, repo string, repo_sha string, ground_truth string, rationale string, provenance string, labeled_by string"
REJECTED = "rule_id string, path string, line int, reason string"
RUN_ROWS = "id string, provenance string, ground_truth string, model string, verdict string, confidence double, schema_valid boolean, completeness string, cost_usd double, latency_ms bigint"


def _read(spark: SparkSession, path: str, schema: str, rule: str) -> DataFrame:
    try:
        rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    ok = F.when(F.expr(rule), F.lit(True)).otherwise(F.raise_error(F.lit(f"row breaks the rule: {rule}")).cast("boolean"))
    return rows.filter(ok)


def entries(spark: SparkSession, path: str) -> DataFrame:
    """Labelled findings; a missing file is empty, a bad row fails the query."""
    return _read(spark, path, ENTRIES, "id IS NOT NULL AND line >= 1 AND length(rationale) > 0 AND ground_truth IN ('TRUE_POSITIVE', 'FALSE_POSITIVE') AND provenance IN ('OWASP_BENCHMARK', 'JULIET', 'CVE_FIX', 'HAND_LABELED', 'REAL_WORLD')")


def rejected(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, REJECTED, "line >= 1 AND length(reason) > 0")


# The domains of a run row.
VERDICTS, LEVELS = ("TRUE_POSITIVE", "FALSE_POSITIVE", "NEEDS_HUMAN_REVIEW"), ("COMPLETE", "PARTIAL", "INSUFFICIENT")


def checked_runs(lines: DataFrame, *carry: str) -> DataFrame:
    """Run rows of JSON lines (value), and in ``problem`` what is wrong with one; blank lines are none. ``carry``: other columns to keep.

    An absent schema_valid is true, an absent cost or latency 0; one that is there must be of its type, null is of none.
    Truth values are no numbers, and a latency is a whole number.
    """
    rows = lines.filter(F.trim("value") != "").select(*carry, F.try_parse_json("value").alias("v"))
    get = lambda k, kind: F.try_variant_get("v", f"$.{k}", kind)
    kind = lambda k: F.coalesce(F.schema_of_variant(F.try_variant_get("v", f"$.{k}", "variant")), F.lit("ABSENT"))
    text = lambda k: F.when(kind(k) == "STRING", get(k, "string"))
    number = kind("cost_usd").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    problem = (
        F.when(F.col("v").isNull() | ~F.schema_of_variant("v").startswith("OBJECT"), "no object")
        .when(F.coalesce(text("id"), F.lit("")) == "", "id")
        .when(~F.coalesce(text("verdict").isin(*VERDICTS), F.lit(False)), "verdict")
        .when(~(kind("completeness").isin("ABSENT", "VOID") | F.coalesce(text("completeness").isin(*LEVELS), F.lit(False))), "completeness")
        .when(~kind("schema_valid").isin("ABSENT", "BOOLEAN"), "schema_valid")
        .when((kind("cost_usd") != "ABSENT") & ~number, "cost_usd")
        .when(~kind("latency_ms").isin("ABSENT", "BIGINT"), "latency_ms")
    )
    return rows.select(
        *carry, get("id", "string").alias("id"), *[get(k, "string").alias(k) for k in ("provenance", "ground_truth", "model", "verdict")], get("confidence", "double").alias("confidence"),
        F.coalesce(get("schema_valid", "boolean"), F.lit(True)).alias("schema_valid"), get("completeness", "string").alias("completeness"), F.coalesce(get("cost_usd", "double"), F.lit(0.0)).alias("cost_usd"),
        F.coalesce(get("latency_ms", "bigint"), F.lit(0)).cast("long").alias("latency_ms"), problem.alias("problem"),
    )


def run_rows(spark: SparkSession, path: str) -> DataFrame:
    """``checked_runs`` of files; the first bad row fails the query, a missing file is empty."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], RUN_ROWS)
    rows = checked_runs(lines)
    bad = F.raise_error(F.concat(F.lit("run row of "), F.coalesce("id", F.lit("no id")), F.lit(" has no usable "), F.col("problem"))).cast("boolean")
    return rows.filter(F.when(F.col("problem").isNull(), F.lit(True)).otherwise(bad)).drop("problem")


def prompt_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """(name, sha256) of the text files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sha256"))
