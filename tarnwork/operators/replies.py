"""Strict reading of recorded replies; what doesn't fit the closed schema is escalated, row by row."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_TEXT, _INT = T.StringType(), T.IntegerType()
_REFS = T.ArrayType(_struct(path=_TEXT, line=_INT, end_line=_INT, snippet=_TEXT))
REPLY = _struct(
    valid=T.BooleanType(), error=_TEXT, position=_TEXT, confidence=T.DoubleType(), reasoning=_TEXT, evidence=_REFS,
    objections=T.ArrayType(_struct(claim=_TEXT, evidence=_REFS, rebutted=T.BooleanType(), rebuttal=_TEXT)), questions=T.ArrayType(_TEXT),
)
# What each role may say, and the limits of its texts.
POSITIONS = ("TRUE_POSITIVE", "FALSE_POSITIVE", "NEEDS_HUMAN_REVIEW")
REASONING, CLAIM, SNIPPET = 3000, 500, 2000
FIELDS = {
    "analyst": ("position", "confidence", "reasoning", "evidence_lines", "unresolved_questions"),
    "adversary": ("position", "confidence", "reasoning", "evidence_lines", "unresolved_questions", "objections"),
    "adjudicator": ("verdict", "confidence", "justification", "evidence_lines", "unresolved_questions", "open_objections"),
}


class Refused(ValueError):
    pass


def _need(ok: bool, what: str):
    if not ok:
        raise Refused(what)


#: Largest number of a line: what the column holds.
LAST_LINE = 2**31 - 1


def _number(x, what: str) -> float:
    _need(isinstance(x, (int, float, str)) and not isinstance(x, bool), what)
    try:
        number = float(x)
    except (ValueError, OverflowError):
        raise Refused(what) from None
    _need(math.isfinite(number), what)
    return number


def _line(x, what: str) -> int:
    number = _number(x, what)
    _need(number == int(number) and 1 <= number <= LAST_LINE, what)
    return int(number)


def _text(x, most: int, what: str) -> str:
    _need(isinstance(x, str) and len(x) <= most, what)
    # half of a surrogate pair is no character and can't be written
    _need(not any("\ud800" <= c <= "\udfff" for c in x), what)
    return x


def _refs(items) -> list[dict]:
    _need(isinstance(items, list), "evidence_lines")
    out = []
    for r in items:
        _need(isinstance(r, dict) and set(r) <= {"path", "line", "end_line", "snippet"} and {"path", "line"} <= set(r), "evidence_lines")
        line = _line(r["line"], "line")
        end = line if r.get("end_line") is None else _line(r["end_line"], "end_line")
        _need(end >= line, "end_line")
        snippet = r.get("snippet")
        out.append({"path": _text(r["path"], 10**9, "path"), "line": line, "end_line": end, "snippet": None if snippet is None else _text(snippet, SNIPPET, "snippet")})
    return out


def _objections(items, answered: bool) -> list[dict]:
    _need(isinstance(items, list), "objections")
    out = []
    for o in items:
        allowed = {"claim", "evidence"} | ({"rebutted", "rebuttal"} if answered else set())
        _need(isinstance(o, dict) and set(o) <= allowed and "claim" in o, "objections")
        cited = _refs(o.get("evidence", []))
        done, reply = o.get("rebutted", False), o.get("rebuttal")
        _need(isinstance(done, bool) and (not done or (isinstance(reply, str) and bool(reply.strip()))), "rebuttal")
        out.append({"claim": _text(o["claim"], CLAIM, "claim"), "evidence": cited, "rebutted": done, "rebuttal": None if reply is None else _text(reply, 10**9, "rebuttal")})
    return out


def read_reply(raw: str | None, role: str) -> dict:
    """One reply, checked: an object, known fields, domains, ranges and lengths. Numbers in strings are taken."""
    blank = {"valid": False, "error": None, "position": None, "confidence": None, "reasoning": None, "evidence": [], "objections": [], "questions": []}
    try:
        try:
            x = json.loads(raw if raw is not None else "")
        except (ValueError, RecursionError):
            raise Refused("not JSON") from None
        _need(isinstance(x, dict), "not an object")
        _need(role in FIELDS, "unknown role")
        fields = FIELDS[role]
        _need(set(x) <= set(fields), "unknown field")
        said, why = fields[0], fields[2]
        _need({said, "confidence", why} <= set(x), "missing field")
        _need(isinstance(x[said], str) and x[said] in POSITIONS and not (role == "adversary" and x[said] == "FALSE_POSITIVE"), said)
        confidence = _number(x["confidence"], "confidence")
        _need(0 <= confidence <= 1, "confidence")
        questions = x.get("unresolved_questions", [])
        _need(isinstance(questions, list) and all(_text(q, 10**9, "unresolved_questions") is q for q in questions), "unresolved_questions")
        objections = _objections(x.get(fields[5], []), role == "adjudicator") if len(fields) > 5 else []
        reasoning = _text(x[why], CLAIM if role == "adjudicator" else REASONING, why)
        return blank | {"valid": True, "position": x[said], "confidence": confidence, "reasoning": reasoning, "evidence": _refs(x.get("evidence_lines", [])), "objections": objections, "questions": questions}
    except Refused as e:
        return blank | {"error": str(e)}


@F.pandas_udf(REPLY)
def parse_reply(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for raw, role in parts:
        yield pd.DataFrame([read_reply(r, k) for r, k in zip(raw, role)], columns=list(read_reply(None, "analyst")))


def strip_fence(raw: Column) -> Column:
    """A reply without the code fence and language tag around it."""
    return F.regexp_replace(F.regexp_replace(F.trim(raw), r"^```(?:json)?\s*", ""), r"\s*```$", "")


def escalate(rows: DataFrame, parsed: str = "parsed") -> DataFrame:
    """Verdict and confidence of parsed replies; invalid ones go to review with confidence 0."""
    ok = F.col(f"{parsed}.valid")
    return rows.withColumns({"verdict": F.when(ok, F.col(f"{parsed}.position")).otherwise("NEEDS_HUMAN_REVIEW"), "confidence": F.when(ok, F.col(f"{parsed}.confidence")).otherwise(0.0), "schema_valid": ok})


def short_circuit(rows: DataFrame) -> DataFrame:
    """Rows of insufficient context go to review without a call and without cost."""
    skip = F.coalesce(F.col("completeness") == "INSUFFICIENT", F.lit(True))
    return rows.withColumns({"escalated_by_completeness": skip, "verdict": F.when(skip, F.lit("NEEDS_HUMAN_REVIEW")).otherwise(F.col("verdict")), "cost_usd": F.when(skip, F.lit(0.0)).otherwise(F.col("cost_usd"))})
