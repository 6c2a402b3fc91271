"""Citations of replies and of their objections: one that isn't there sends the verdict to review."""

import json

import pytest
from pyspark.sql import functions as F

from tarnwork.operators import records, replies, verdicts


def reply(own, against, role="adjudicator", **more):
    said = {"adjudicator": "verdict", "adversary": "position"}[role], {"adjudicator": "justification", "adversary": "reasoning"}[role], {"adjudicator": "open_objections", "adversary": "objections"}[role]
    return json.dumps({said[0]: "TRUE_POSITIVE", "confidence": 1, said[1]: "j", "evidence_lines": own, said[2]: [{"claim": "c", "evidence": e} for e in against]} | more)


REF = lambda path, line, end=None: {"path": path, "line": line, "end_line": end}
GOOD, PAST = REF("a.py", 3), REF("a.py", 3, 99)


@pytest.mark.parametrize(
    "own, against, origins",
    [
        ([GOOD], [[GOOD]], []), ([], [], []), ([PAST], [[GOOD]], ["reply"]), ([GOOD], [[GOOD], [GOOD, PAST]], ["objection 1"]), ([GOOD], [[REF("gone.py", 1)]], ["objection 0"]),
        ([REF("../a.py", 1)], [[REF("/a.py", 1)]], ["objection 0", "reply"]), ([REF("./a.py", 1), REF("a%2Epy", 10)], [], []), ([REF("a.py", 11)], [[], [REF("C:/a.py", 1)]], ["objection 1", "reply"]),
    ],
)
def test_invented_citations(spark, own, against, origins):
    files = spark.createDataFrame([("a.py", 10), ("b.py", 5)], "path string, n_lines int")
    rows = spark.createDataFrame([(1, reply(own, against)), (2, "no reply")], "id int, raw string").withColumn("parsed", replies.parse_reply("raw", F.lit("adjudicator")))
    rows = replies.escalate(rows).withColumns({"downgraded_from": F.lit(None).cast("string"), "downgrade_reason": F.lit(None).cast("string")})
    out = {r.id: r for r in verdicts.check_evidence(rows, files).collect()}
    assert [i.origin for i in out[1].invented] == origins
    assert (out[1].verdict, out[1].downgraded_from, out[1].downgrade_reason) == (("NEEDS_HUMAN_REVIEW", "TRUE_POSITIVE", verdicts.CITATION_REASON) if origins else ("TRUE_POSITIVE", None, None))
    assert out[2].verdict == "NEEDS_HUMAN_REVIEW" and out[2].invented == []


def test_arguments_keep_what_they_cite(spark):
    raw = reply([GOOD], [[PAST]], "adversary", unresolved_questions=["why"])
    row = spark.createDataFrame([(raw,)], "raw string").withColumn("parsed", replies.parse_reply("raw", F.lit("adversary")))
    one = row.select(records.as_argument("adversary", F.col("parsed")).alias("a")).first().a
    assert [(e.path, e.line) for e in one.evidence_lines] == [("a.py", 3)] and one.unresolved_questions == ["why"]
    assert [(o.evidence[0].end_line, o.rebutted, o.rebuttal) for o in one.objections] == [(99, False, None)]
    assert row.select(records.as_argument("analyst", F.col("parsed")).alias("a")).first().a.objections == []
