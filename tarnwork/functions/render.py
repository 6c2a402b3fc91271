"""Text of reports, comments and cache keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADINGS = (("TRUE_POSITIVE", "## Likely true positives"), ("NEEDS_HUMAN_REVIEW", "## Needs human review"), ("FALSE_POSITIVE", "## Dismissed with justification"))


def finding_line(rule: Column, uri: Column, line: Column, confidence: Column, why: Column) -> Column:
    number = F.when(F.coalesce(line, F.lit(0)) != 0, line.cast("string")).otherwise(F.lit("?"))
    return F.concat(F.lit("- `"), F.coalesce(rule, F.lit("unknown-rule")), F.lit("` at `"), F.coalesce(uri, F.lit("(unknown file)")), F.lit(":"), number, F.lit("` (confidence "), F.format_string("%.2f", confidence), F.lit(") - "), why)


def comment_sections(triaged: DataFrame) -> DataFrame:
    """(position, verdict, body) of the three sections of a comment; lines by run and result.

    The lines of one comment are one document for a reader; triaged must be the findings of one comment.
    """
    text = finding_line(F.col("rule_id"), F.col("uri"), F.col("start_line"), F.col("confidence"), F.col("justification"))
    rows = triaged.select("verdict", F.struct("run_index", "result_index", text.alias("text")).alias("s"))
    body = rows.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list("s")), lambda s: s["text"]).alias("lines"))
    every = triaged.sparkSession.createDataFrame([(i, v, h) for i, (v, h) in enumerate(HEADINGS)], "position int, verdict string, heading string")
    full = every.join(body, "verdict", "left")
    inner = F.when(F.col("n").isNull(), F.lit("_None._")).otherwise(F.array_join("lines", "\n"))
    return full.select("position", "verdict", F.concat("heading", F.lit(" ("), F.coalesce("n", F.lit(0)).cast("string"), F.lit(")\n\n"), inner).alias("body"))


def cache_key(*parts: Column) -> Column:
    """Hash of all that a verdict depends on; nulls count."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("\0null")) for p in parts])), 256)


def seeded_order(rows: DataFrame, group: str, item: str) -> DataFrame:
    """Adds ``place``: a reproducible order of a group's items by hash. A documented departure from a shuffle by a generator."""
    w = Window.partitionBy(group).orderBy(F.sha2(F.concat_ws("\0", F.col(group).cast("string"), F.col(item).cast("string")), 256), item)
    return rows.withColumn("place", F.row_number().over(w))


def substitute(template: str, fields: dict[str, Column]) -> Column:
    """A template's text with {name} filled in, in one pass; {{ and }} stand for braces. Fields are never expanded again."""
    import string

    parts = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(F.coalesce(fields[name].cast("string"), F.lit("None")))
    return F.concat(*parts) if parts else F.lit("")


# What stands where a bundle has nothing.
NO_SANITIZER, NO_SPAN, NO_FLOW, NOTHING = "none-confirmed", "(no spans retrieved)", "(none provided)", "none"


def bundle_fields(columns: list[str]) -> dict[str, Column]:
    """The texts that a prompt's template takes from a bundle, for ``substitute``.

    Columns that the bundles lack count as null. Booleans read True, False or None; spans are quoted blocks already;
    data_flow is an array of (order, path, line, source_line).
    """
    at = lambda name, kind="string": F.col(name).cast(kind) if name in columns else F.lit(None).cast(kind)
    listed = lambda name, sep, empty: F.coalesce(F.nullif(F.array_join(at(name, "array<string>"), sep), F.lit("")), F.lit(empty))
    said = lambda name: F.coalesce(F.initcap(at(name, "boolean").cast("string")), F.lit("None"))
    steps = F.transform(at("data_flow", "array<struct<order:int,path:string,line:int,source_line:string>>"), lambda s: F.concat(s["order"], F.lit(": "), s["path"], F.lit(":"), s["line"], F.lit(" "), s["source_line"]))
    return {
        "rule_id": at("rule_id"), "message": F.coalesce(F.nullif(at("message"), F.lit("")), at("rule_id")), "file_class": at("file_class"), "completeness": at("completeness"),
        "completeness_reasons": listed("reasons", ",", NOTHING), "externally_reachable": said("externally_reachable"), "entrypoint_kind": at("entrypoint_kind"),
        "caller_search_refused": said("refused"), "caller_search_truncated": said("truncated"), "direct_caller_count": F.coalesce(at("direct_callers", "long"), F.lit(0)).cast("string"),
        "sanitizers": listed("trusted_callees", ",", NO_SANITIZER), "imports": listed("imports", ",", NOTHING), "context_block": listed("spans", "\n\n", NO_SPAN),
        "data_flow": F.coalesce(F.nullif(F.array_join(steps, "\n"), F.lit("")), F.lit(NO_FLOW)),
    }
