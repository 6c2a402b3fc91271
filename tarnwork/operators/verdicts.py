"""Rules that verdicts must pass; each fails closed, towards review by a human."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.functions import paths

# The floor of confidence of a dismissal, and reasons that alone make context insufficient.
FLOOR = 0.85
INSUFFICIENT_REASONS = ("enclosing-function-unresolved", "dynamic-dispatch", "c-extension-boundary")
REFUSED = "caller-search-refused"
CITATION_REASON = "cited evidence does not exist"


def completeness(reasons: Column, externally_reachable: Column) -> Column:
    bad = F.arrays_overlap(reasons, F.array(*[F.lit(r) for r in INSUFFICIENT_REASONS]))
    open_ = F.array_contains(reasons, REFUSED) & externally_reachable.isNull()
    return F.when(F.size(reasons) == 0, "COMPLETE").when(bad | open_, "INSUFFICIENT").otherwise("PARTIAL")


def safety_gate(rows: DataFrame) -> DataFrame:
    """Turns a FALSE_POSITIVE that misses any condition into NEEDS_HUMAN_REVIEW.

    Reads verdict, confidence, open_objections (array of struct with rebutted), objection_count,
    completeness; sets verdict, downgraded_from, downgrade_reason. A null completeness blocks too.
    """
    carried, unrebutted = F.size("open_objections"), F.size(F.filter("open_objections", lambda o: ~o["rebutted"]))
    reasons = F.concat_ws(
        "; ",
        F.when(F.col("confidence") < FLOOR, F.format_string(f"confidence %.2f < {FLOOR}", "confidence")),
        F.when(unrebutted > 0, F.concat(unrebutted.cast("string"), F.lit(" unrebutted adversary objection(s)"))),
        F.when(F.col("objection_count") == 0, F.lit("adversary filed zero objections")).when(
            carried < F.col("objection_count"), F.concat((F.col("objection_count") - carried).cast("string"), F.lit(" adversary objection(s) dropped before adjudication"))
        ),
        F.when(F.coalesce("completeness", F.lit("None")).isin("None", "INSUFFICIENT"), F.concat(F.lit("context completeness is "), F.coalesce("completeness", F.lit("None")))),
    )
    down = (F.col("verdict") == "FALSE_POSITIVE") & (reasons != "")
    return rows.withColumns({"downgraded_from": F.when(down, F.col("verdict")), "downgrade_reason": F.when(down, reasons), "verdict": F.when(down, F.lit("NEEDS_HUMAN_REVIEW")).otherwise(F.col("verdict"))})


def citations_exist(cited: DataFrame, files: DataFrame) -> DataFrame:
    """(id, ok): whether all of a row's refs (array of struct path, line, end_line) lie within files(path, n_lines).

    One miss fails the row; a row without refs passes.
    """
    refs = cited.select("id", F.explode_outer("refs").alias("r")).select("id", F.col("r.path").alias("path"), F.col("r.line").alias("line"), F.coalesce("r.end_line", "r.line").alias("end_line"), F.col("r").isNull().alias("none"))
    good = F.col("none") | F.coalesce((F.col("line") >= 1) & (F.col("end_line") >= F.col("line")) & (F.col("end_line") <= F.col("n_lines")), F.lit(False))
    return refs.join(files, "path", "left").groupBy("id").agg(F.bool_and(good).alias("ok"))


def evidence(rows: DataFrame, parsed: str = "parsed") -> DataFrame:
    """(id, origin, path, line, end_line): all that parsed replies cite, in their own lines and in those of each objection.

    ``origin`` is ``reply``, or ``objection`` and its place from 0. Replies that are not valid cite nothing.
    """
    reply, ref = F.col(parsed), lambda r: F.struct(r["path"].alias("path"), r["line"].alias("line"), F.coalesce(r["end_line"], r["line"]).alias("end_line"))
    own = F.transform(reply["evidence"], lambda r: F.struct(F.lit("reply").alias("origin"), ref(r).alias("ref")))
    of_objection = lambda o, k: F.transform(o["evidence"], lambda r: F.struct(F.concat(F.lit("objection "), k.cast("string")).alias("origin"), ref(r).alias("ref")))
    against = F.flatten(F.transform(reply["objections"], of_objection))
    none = F.array().cast("array<struct<origin:string,ref:struct<path:string,line:int,end_line:int>>>")
    return rows.select("id", F.explode(F.concat(F.coalesce(own, none), F.coalesce(against, none))).alias("e")).select("id", "e.origin", "e.ref.*")


def invented(cited: DataFrame, files: DataFrame) -> DataFrame:
    """Of ``evidence`` what doesn't lie in files(path, n_lines): refused paths, files that aren't there, lines beyond the end."""
    known = files.select(F.col("path").alias("_path"), "n_lines")
    cited = cited.withColumn("_at", F.when(paths.refusal(paths.normal_uri(F.col("path"))).isNull(), paths.normal_uri(F.col("path"))))
    there = (F.col("_at") == F.col("_path")) & (F.col("line") >= 1) & (F.col("end_line") >= F.col("line")) & (F.col("end_line") <= F.col("n_lines"))
    return cited.join(known, there, "left_anti").drop("_at")


def check_evidence(rows: DataFrame, files: DataFrame, parsed: str = "parsed") -> DataFrame:
    """Sends every verdict to review whose reply, or any of its objections, cites what isn't there.

    Reads id, parsed, verdict, downgraded_from, downgrade_reason; adds ``invented``, the citations at fault with their origin.
    """
    fault = F.struct("origin", "path", "line", "end_line")
    bad = invented(evidence(rows, parsed), files).groupBy("id").agg(F.array_sort(F.collect_list(fault)).alias("invented"))
    rows = rows.join(bad, "id", "left").withColumn("ok", F.col("invented").isNull())
    return override_missing(rows).withColumn("invented", F.coalesce("invented", F.array())).drop("ok")


def override_missing(rows: DataFrame) -> DataFrame:
    """Any verdict whose citations are not all there goes to review; an earlier downgrade keeps its origin."""
    bad = ~F.coalesce("ok", F.lit(False))
    return rows.withColumns(
        {
            "downgraded_from": F.when(bad, F.coalesce("downgraded_from", "verdict")).otherwise(F.col("downgraded_from")),
            "downgrade_reason": F.when(bad, F.concat_ws("; ", "downgrade_reason", F.lit(CITATION_REASON))).otherwise(F.col("downgrade_reason")),
            "verdict": F.when(bad, F.lit("NEEDS_HUMAN_REVIEW")).otherwise(F.col("verdict")),
        }
    )
