"""Reports: one JSON document or one text from a table of results."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.functions.render import comment_sections
from tarnwork.operators import records
from tarnwork.operators.scoring import PROVENANCES, verdict_report

MARKER = "<!-- triage-report -->"


def run_report(triaged: DataFrame, stamps: dict[str, str]) -> DataFrame:
    """One row with the JSON report of a run: totals, counts of each verdict, stamps such as model and prompt hashes."""
    v = verdict_report(triaged)
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("verdict", "n"))))
    one = v.agg(F.sum("n").alias("total"), counts.alias("verdicts"), F.sum("cost_usd").alias("cost_usd"), F.sum("latency_ms").alias("latency_ms"))
    stamp = F.create_map(*[F.lit(x) for k in sorted(stamps) for x in (k, stamps[k])]) if stamps else F.create_map().cast("map<string,string>")
    return one.select(F.to_json(F.struct("total", "verdicts", "cost_usd", "latency_ms", stamp.alias("stamps")), {"ignoreNullFields": "false"}).alias("report"))


def outputs(report: DataFrame) -> DataFrame:
    """The report's figures as (key, value) rows."""
    r = report.select(F.from_json("report", "total long, verdicts map<string,long>, cost_usd double, latency_ms long").alias("r"))
    whole = r.select(F.explode(F.create_map(F.lit("total"), F.col("r.total").cast("string"), F.lit("cost_usd"), F.col("r.cost_usd").cast("string"), F.lit("latency_ms"), F.col("r.latency_ms").cast("string"))).alias("key", "value"))
    each = r.select(F.explode("r.verdicts").alias("key", "value")).select(F.lower("key").alias("key"), F.col("value").cast("string").alias("value"))
    return whole.unionByName(each)


def comment(triaged: DataFrame, cost_usd: float, dry_run: bool = False) -> DataFrame:
    """One row with the text of a comment, its marker first."""
    s = comment_sections(triaged).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "body"))), lambda x: x["body"]), "\n\n").alias("sections"))
    note = "**Dry run**: no model was called, nothing below was judged.\n\n" if dry_run else ""
    return s.select(F.concat(F.lit(f"{MARKER}\n# Triage report\n\n{note}"), "sections", F.lit(f"\n\nTotal cost: ${cost_usd:.4f}\n")).alias("text"))


def upsert(comments: DataFrame, key: str, text: str, marker: str = MARKER) -> DataFrame:
    """Comments (key, id, text) after the first one that starts with the marker was replaced, or one was added."""
    mine = (F.col("key") == key) & F.col("text").startswith(marker)
    first = F.min(F.when(mine, F.col("id"))).over(Window.partitionBy("key"))
    kept = comments.withColumn("_first", first).withColumn("text", F.when(mine & (F.col("id") == F.col("_first")), F.lit(text)).otherwise(F.col("text"))).drop("_first")
    top = comments.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"), F.count_if(mine).alias("_mine")).filter("_mine = 0")
    return kept.unionByName(top.select(F.lit(key).alias("key"), (F.col("_top") + 1).alias("id"), F.lit(text).alias("text")).select(*comments.columns))


def manifest(files: DataFrame) -> DataFrame:
    """(path, sha256, bytes, runs, results) of log files (path, content); a file that isn't such a log has no runs."""
    text = F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), "^\ufeff", "")
    runs = F.try_variant_get(F.try_parse_json(text), "$.runs", "array<variant>")
    results = F.transform(runs, lambda r: F.coalesce(F.size(F.try_variant_get(r, "$.results", "array<variant>")), F.lit(0)))
    total = F.aggregate(F.filter(results, lambda n: n > 0), F.lit(0).cast("long"), lambda a, n: a + n)
    return files.select(
        "path", F.sha2("content", 256).alias("sha256"), F.length("content").alias("bytes"), F.when(runs.isNull(), 0).otherwise(F.size(runs)).alias("runs"), F.coalesce(total, F.lit(0).cast("long")).alias("results")
    )


def most_common(rows: DataFrame, value: str, seen: str) -> DataFrame:
    """(value, n, first, place): values by falling count, ties by who was seen first. A row for each distinct value."""
    n = rows.groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(seen).alias("first"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), F.asc("first"), F.asc("value"))))


def dump(bundles: DataFrame, fields: list[str], most: int = 20) -> DataFrame:
    """(run_index, result_index, entry) of the first bundles by run and result: JSON with null fields, and the blocks as
    they would be sent if there is a column of spans."""
    entry = F.to_json(F.struct(*[F.col(f) for f in fields]), {"ignoreNullFields": "false"})
    sent = [F.col("spans").alias("as_sent")] if "spans" in bundles.columns else []
    return bundles.orderBy("run_index", "result_index").limit(most).select("run_index", "result_index", entry.alias("entry"), *sent)


def write_apart(rows: DataFrame, path: str) -> None:
    """Rows of several runs (column ``run``), each in a folder of its own; nothing is pooled."""
    rows.write.mode("overwrite").partitionBy("run").json(path)


def eval_report(scores: DataFrame, rejected: DataFrame, private: DataFrame, settings: dict[str, str], injection: DataFrame | None = None) -> DataFrame:
    """One row with the text of an evaluation: settings, rejected candidates, holdout, a line for each provenance group.

    scores are ``by_provenance``'s rows, rejected (reason, n), private ``holdout``'s row, injection that of
    ``injection_resistance``. All are a handful of rows at any size. Metrics without a value read n/a.
    """
    share = lambda c: records.share_text(F.col(c))
    shares = ["false_suppression_rate", "coverage", "precision", "recall", "escalation_rate", "schema_failure_rate"]
    cells = [F.col("provenance"), F.col("count").cast("string"), *[share(c) for c in shares], records.money_text(F.col("cost_per_finding")), records.time_text(F.col("p95_latency_ms"))]
    head = ["provenance", "count", *[c.replace("_", " ") for c in shares], "cost per finding", "p95 latency"]
    groups = F.array(*[F.lit(g) for g in PROVENANCES])
    lines = lambda place, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), text.alias("t")))), lambda x: x["t"]), "\n")
    row = lambda *c: F.concat(F.lit("| "), F.concat_ws(" | ", *c), F.lit(" |"))
    top = lambda names: "| " + " | ".join(names) + " |\n|" + " --- |" * len(names) + "\n"
    section = lambda df, place, text: df.select(F.lit(place).alias("place"), text.alias("text"))
    spark = scores.sparkSession
    first = spark.createDataFrame([(0, "# Evaluation\n\n" + "\n".join(f"- {k}: {settings[k]}" for k in sorted(settings)))], "place int, text string")
    refused = rejected.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), lines(F.col("reason"), row(F.col("reason"), F.col("n").cast("string"))).alias("t"))
    held = F.concat(F.lit("Private holdout: "), F.col("private").cast("string"), F.lit(" findings"), F.when(F.col("thin"), "; too few for a point estimate").otherwise(""))
    table = scores.agg(lines(F.array_position(groups, F.col("provenance")), row(*cells)).alias("t"))
    unmeasured = records.any_scored(scores, ["precision", "recall", "false_suppression_rate"])
    parts = [
        first,
        section(refused, 1, F.concat(F.lit("## Rejected candidates: "), F.col("n").cast("string"), F.when(F.col("n") > 0, F.concat(F.lit("\n\n" + top(["reason", "count"])), F.col("t"))).otherwise(""))),
        section(private, 2, held),
        section(table, 3, F.concat(F.lit("## By provenance\n\n" + top(head)), F.col("t"))),
        section(unmeasured.filter("NOT coalesce(scored, false)"), 5, F.lit("## Not yet measured\n\nNo finding was scored.")),
    ]
    if injection is not None:
        parts.append(section(injection, 4, F.concat(F.lit("## Injection resistance\n\n"), F.col("resisted").cast("string"), F.lit(" of "), F.col("count").cast("string"), F.lit(": "), share("rate"))))
    return functools.reduce(DataFrame.unionByName, parts).agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n\n"), F.lit("\n")).alias("text"))


def write_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
