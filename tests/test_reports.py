"""Evaluation report, listings, dumps, manifests, runs kept apart, logs without volatile fields, prompt fields."""

import json
import subprocess

from tarnwork.functions import render
from tarnwork.operators import records, scoring
from tarnwork.sources import reports, scanlogs

PAIRS = "id long, provenance string, ground_truth string, verdict string, completeness string, schema_valid boolean, cost_usd double, latency_ms long"


def _text(spark, rows, rejected, injection=None):
    pairs = spark.createDataFrame(rows, PAIRS)
    r = spark.createDataFrame(rejected, "reason string, n long")
    return reports.eval_report(scoring.by_provenance(pairs), r, scoring.holdout(pairs), {"model": "m", "budget": "$5.00"}, injection).first().text


def test_report_of_an_evaluation(spark):
    rows = [(1, "JULIET", "TRUE_POSITIVE", "TRUE_POSITIVE", "COMPLETE", True, 0.5, 10), (2, "JULIET", "TRUE_POSITIVE", "FALSE_POSITIVE", "PARTIAL", True, 0.5, 20)]
    bait = scoring.injection_resistance(spark.createDataFrame(rows, PAIRS))
    text = _text(spark, rows, [("b", 2), ("a", 1)], bait)
    lines = text.split("\n")
    assert lines[0] == "# Evaluation" and lines[2:4] == ["- budget: $5.00", "- model: m"] and text.endswith("\n")
    assert lines.index("| a | 1 |") + 1 == lines.index("| b | 2 |") and "## Rejected candidates: 3" in lines
    assert "| JULIET | 2 | 50.0% | 100.0% | 100.0% | 50.0% | 0.0% | 0.0% | $0.5000 | 20 ms |" in lines
    assert [x.split(" ")[1] for x in lines if x.startswith(("| OW", "| JU", "| CV", "| HA", "| RE"))] == list(scoring.PROVENANCES)
    assert "1 of 2: 50.0%" in lines and "Not yet measured" not in text


def test_report_of_nothing(spark):
    text = _text(spark, [], [])
    assert "## Not yet measured" in text and "| JULIET | 0 | n/a | 100.0% | n/a |" in text and "## Rejected candidates: 0\n" in text
    assert "Private holdout: 0 findings; too few" in text and "Injection" not in text


def test_ties_go_to_the_first_seen(spark):
    df = spark.createDataFrame([(0, "z"), (1, "a"), (2, "a"), (3, "z"), (4, "m"), (5, None)], "at long, v string")
    assert [r.value for r in reports.most_common(df, "v", "at").orderBy("place").collect()] == ["z", "a", "m", None]


def test_dump_keeps_null_fields_and_order(spark):
    df = spark.createDataFrame([(1, 0, None, ["<b>"]), (0, 1, "x", []), (0, 0, "y", None)], "run_index int, result_index int, f string, spans array<string>")
    got = reports.dump(df, ["f"], 2).collect()
    assert [(r.entry, r.as_sent) for r in got] == [('{"f":"y"}', None), ('{"f":"x"}', [])]
    assert len(reports.dump(df.drop("spans"), ["f"]).collect()) == 3


def test_manifest_counts_runs_and_results(spark):
    logs = [{"runs": [{"results": [{}, {}]}, {"results": []}, {}]}, {"runs": []}, {}]
    rows = [(str(i), bytearray(json.dumps(x).encode("utf-8-sig"))) for i, x in enumerate(logs)] + [("bad", bytearray(b"\xff{")), ("none", None)]
    got = {r.path: (r.runs, r.results) for r in reports.manifest(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {"0": (3, 2), "1": (0, 0), "2": (0, 0), "bad": (0, 0), "none": (0, 0)}


def test_runs_stay_apart(spark, tmp_path):
    reports.write_apart(spark.createDataFrame([("a", 1), ("b", 2), ("injection", 3)], "run string, id long"), str(tmp_path / "out"))
    assert [r.id for r in spark.read.json(str(tmp_path / "out" / "run=b")).collect()] == [2]
    assert len(list((tmp_path / "out").glob("run=*"))) == 3


def test_volatile_fields_go_and_the_rest_stays():
    run = {
        "originalUriBaseIds": {"ROOT": {"uri": "file:///home/u/p/"}, "X": "odd"}, "artifacts": [{"location": {"uri": "/home/u/p/a.py"}}, {}, 3],
        "invocations": [{"startTimeUtc": "t", "endTimeUtc": "t", "exitCode": 0}], "results": [{"message": {"text": "é"}}],
    }
    out = json.loads(scanlogs.scrubbed(json.dumps({"version": "2.1.0", "runs": [run]}), "/home/u/p"))["runs"][0]
    assert out["originalUriBaseIds"] == {"ROOT": {"uri": "file:///src/"}, "X": "odd"} and out["artifacts"] == [{"location": {"uri": "a.py"}}, {}, 3]
    assert out["invocations"] == [{"exitCode": 0}] and out["results"] == run["results"]
    assert json.loads(scanlogs.scrubbed('{"runs": null}', "/x")) == {"runs": None}


def test_fields_of_a_prompt(spark):
    df = spark.createDataFrame(
        [("r", "", True, None, ["a", "b"], [], [(1, "p", 3, "x={y}")]), ("r", "m", None, 4, None, ["<s>", "<t>"], None)],
        "rule_id string, message string, externally_reachable boolean, direct_callers long, reasons array<string>, spans array<string>, data_flow array<struct<order:int,path:string,line:int,source_line:string>>",
    )
    f = render.bundle_fields(df.columns)
    template = "{message}|{externally_reachable}|{direct_caller_count}|{completeness_reasons}|{context_block}|{data_flow}|{sanitizers}|{caller_search_refused}|{{x}}"
    got = [r[0] for r in df.select(render.substitute(template, f)).collect()]
    assert got == ["r|True|0|a,b|(no spans retrieved)|1: p:3 x={y}|none-confirmed|None|{x}", "m|None|4|none|<s>\n\n<t>|(none provided)|none-confirmed|None|{x}"]


def test_stamp_of_a_working_copy(tmp_path):
    assert records.source_stamp(str(tmp_path / "absent")) is None
    git = ["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@example.org"]
    subprocess.run([*git, "init", "-q"], check=True)
    subprocess.run([*git, "commit", "-q", "--allow-empty", "-m", "x"], check=True)
    assert len(records.source_stamp(str(tmp_path))) == 40
