"""Small steps between the stages: control rows, annotations, arguments, tallies, stamps."""

from __future__ import annotations

import re
import subprocess

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.operators import costs

AGENTS = ("reachability", "exploitability", "adversary", "adjudicator")


def same_temperature(config: dict[str, dict]) -> None:
    """All agents of a run share one temperature; anything else is refused before a call is made."""
    if len({config[a].get("temperature") for a in AGENTS}) != 1:
        raise ValueError("agents differ in temperature")


def checked_provider(config: dict) -> dict:
    """A provider's settings: a key is needed, the address is https, its last slash goes."""
    if not config.get("api_key"):
        raise ValueError("no key")
    if not re.match("https://", config.get("base_url", "")):
        raise ValueError("address is not https")
    return config | {"base_url": config["base_url"].rstrip("/")}


def reportable(prompt_hashes: Column) -> Column:
    return F.coalesce(F.size(prompt_hashes) > 0, F.lit(False))


def all_escalate(entries: DataFrame) -> DataFrame:
    """Control rows: every entry to review, without context, cost or time."""
    return entries.select(
        "id", "provenance", "ground_truth", F.lit("all-escalate").alias("model"), F.lit("NEEDS_HUMAN_REVIEW").alias("verdict"), F.lit(0.0).alias("confidence"), F.lit(True).alias("schema_valid"),
        F.lit(None).cast("string").alias("completeness"), F.lit(0.0).alias("cost_usd"), F.lit(0).cast("long").alias("latency_ms"),
    )


def gateway_reply(raw: Column) -> Column:
    """(content, tokens_in, tokens_out) of a chat completion; missing token counts are 0, missing content null."""
    v = F.try_parse_json(raw)
    count = lambda p: F.coalesce(F.try_variant_get(v, p, "long"), F.lit(0))
    return F.struct(F.try_variant_get(v, "$.choices[0].message.content", "string").alias("content"), count("$.usage.prompt_tokens").alias("tokens_in"), count("$.usage.completion_tokens").alias("tokens_out"))


def runtime_cost(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Cost as billed at run time: no cache multipliers, unknown models are free."""
    return (tokens_in * costs.price(model, 0) + tokens_out * costs.price(model, 1)) / F.lit(1e6)


def as_argument(role: str, parsed: Column) -> Column:
    """A parsed reply as a stored argument, with all that it cites; an adversary's objections are open, an analyst has none."""
    opened = F.transform(
        parsed["objections"], lambda o: F.struct(o["claim"].alias("claim"), o["evidence"].alias("evidence"), F.lit(False).alias("rebutted"), F.lit(None).cast("string").alias("rebuttal"))
    )
    none = F.filter(opened, lambda o: F.lit(False))
    said = [parsed[c].alias(c) for c in ("position", "confidence", "reasoning")]
    return F.struct(F.lit(role).alias("role"), *said, parsed["evidence"].alias("evidence_lines"), (opened if role == "adversary" else none).alias("objections"), parsed["questions"].alias("unresolved_questions"))


def own_fields(adjudications: DataFrame, arguments: DataFrame, bundles: DataFrame) -> DataFrame:
    """Sets what the engine knows better than a reply: id, number of the adversary's objections, completeness."""
    filed = arguments.filter("role = 'adversary'").select("id", F.size("objections").alias("_filed"))
    known = bundles.select("id", F.col("completeness").alias("_completeness"))
    rows = adjudications.join(filed, "id", "left").join(known, "id", "left")
    return rows.withColumns({"objection_count": F.coalesce("_filed", F.lit(0)), "completeness": F.col("_completeness")}).drop("_filed", "_completeness")


def annotation(rows: DataFrame) -> Column:
    """JSON of a finding's annotation: five keys where it was settled without judgment, fourteen where it was judged."""
    short = ["correlation_id", "identity_source", "disposition", "resolved_by", "justification"]
    long = ["correlation_id", "identity_source", "disposition", "resolved_by", "verdict", "confidence", "justification", "completeness", "objection_count", "downgraded_from", "downgrade_reason", "cost_usd", "latency_ms", "arguments"]
    bag = lambda names: F.to_json(F.struct(*[F.col(n) for n in names if n in rows.columns]), {"ignoreNullFields": "false"})
    return F.when(F.col("verdict").isNull(), bag(short)).otherwise(bag(long)) if "verdict" in rows.columns else bag(short)


def all_spans(*groups: Column) -> Column:
    """Arrays of spans in order, without nulls."""
    return F.filter(F.concat(*[F.coalesce(g, F.array().cast("array<string>")) for g in groups]), lambda s: s.isNotNull())


def any_scored(report: DataFrame, metrics: list[str], injection: Column | None = None) -> DataFrame:
    some = F.bool_or(F.coalesce(*[F.col(m).cast("double") for m in metrics]).isNotNull())
    return report.agg((some | F.coalesce(F.bool_or(injection), F.lit(False)) if injection is not None else some).alias("scored"))


def tallies(rows: DataFrame) -> DataFrame:
    """Counts of verdicts, spend and calls of each run."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    return rows.groupBy("run").agg(n("TRUE_POSITIVE").alias("tp"), n("FALSE_POSITIVE").alias("fp"), n("NEEDS_HUMAN_REVIEW").alias("escalated"), F.sum("cost_usd").alias("spend"), F.count_if(F.col("cost_usd") > 0).alias("calls"))


def first_match(names: DataFrame, table: list[tuple[str, str]], column: str) -> Column:
    """Value of the first (needle, value) whose needle is in the text, in the table's order; null if none."""
    hits = F.filter(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(v).alias("v")) for n, v in table]), lambda x: F.contains(F.col(column), x["n"]))
    return F.get(hits, F.lit(0))["v"]


def _text(form: str, value: Column) -> Column:
    """A number by a format, n/a where there is none. Rounded by its exact value, halves to even: Spark's own format rounds
    the shortest decimal that stands for a number, halves up."""

    @F.pandas_udf("string")
    def written(x: pd.Series) -> pd.Series:
        return x.map(lambda v: "n/a" if pd.isna(v) else form % v)

    return written(value.cast("double"))


def share_text(ratio: Column) -> Column:
    return _text("%.1f%%", ratio * 100)


def money_text(usd: Column) -> Column:
    return _text("$%.4f", usd)


def time_text(ms: Column) -> Column:
    return _text("%.0f ms", ms)


# How a finding is marked that no budget was left for.
EXHAUSTED, EXHAUSTED_WHY = "triage:budget-exhausted", "budget exceeded before this finding could be adjudicated; escalate to a human"


def mark_exhausted(decisions: DataFrame, judged: str = "verdict") -> DataFrame:
    """Findings that were to be judged and have no verdict say that the budget ran out."""
    left = (F.col("disposition") == "ADJUDICATE") & F.col(judged).isNull()
    return decisions.withColumns({"resolved_by": F.when(left, EXHAUSTED).otherwise(F.col("resolved_by")), "justification": F.when(left, EXHAUSTED_WHY).otherwise(F.col("justification"))})


def source_stamp(folder: str) -> str | None:
    """The commit of a working copy, null where there is none."""
    try:
        done = subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.strip() or None if done.returncode == 0 else None
