import json

import pytest
from pyspark.sql import functions as F

from tarnwork.functions import canonical, paths
from tarnwork.operators import bundles
from tarnwork.sources import pysource, reports

APP = '''
@app.route("/x")
def handler(q):
    return middle(q)

def middle(q):
    return run(q)

def run(q):
    return quote(helper(q))

def helper(q):
    return q

def risky(q):
    return eval(q)
'''
HUB = "def hub():\n    pass\n" + "".join(f"\ndef c{i:03}():\n    hub()\n" for i in range(60))
WIDE = "def wide():\n    pass\n" + "".join(f"\ndef d{i:03}():\n    wide()\n" for i in range(25))


def built(spark, findings, files):
    files = spark.createDataFrame(files, "path string, text string, project boolean")
    return {r.id: r for r in bundles.build(spark.createDataFrame(findings, "id int, uri string, line int"), files, pysource.symbols(files).cache()).collect()}


def test_bundles(spark):
    files = [("app.py", APP, True), ("hub.py", HUB, True), ("wide.py", WIDE, True), ("big.py", None, True)]
    out = built(spark, [(1, "app.py", 10), (2, "./app.py", 16), (3, "hub.py", 2), (4, "wide.py", 2), (5, "app.py", None), (6, None, None), (7, "../x.py", 1), (8, "gone.py", 1), (9, "tests/big.py", 4), (10, "big.py", 1)], files)
    assert len(out) == 10
    one = out[1]
    assert (one.enclosing_function.symbol, one.reachability.entrypoint_kind, one.completeness) == ("run", "HTTP_HANDLER", "COMPLETE")
    assert [(c.caller.symbol, c.call_line, c.hops_from_finding) for c in one.callers] == [("middle", 7, 1), ("handler", 4, 2)]
    assert [c.caller.symbol for c in one.reachability.path_from_entrypoint] == ["handler", "middle"] and one.reachability.entrypoint.symbol == "handler"
    assert [r.split("#")[1] for r in one.route] == [str(APP.index("@app")), str(APP.index("def middle")), str(APP.index("def run"))]
    assert [d.symbol for d in one.called_definitions] == ["helper"] and [(s.name, s.location.line, s.definition is not None, s.confirmed) for s in one.sanitizers] == [("quote", 10, False, True), ("helper", 10, True, True)]
    assert one.called_definitions[0].source == "def helper(q):\n    return q"
    assert (out[2].reasons, out[2].completeness) == (["dynamic-dispatch"], "INSUFFICIENT")
    hub = out[3].caller_search
    assert (hub.refused, hub.direct_caller_count, hub.spans_used, out[3].callers, out[3].completeness, out[3].reachability.notes) == (True, 60, 0, [], "INSUFFICIENT", [bundles.NOTE])
    wide = out[4].caller_search
    assert (len(out[4].callers), out[4].reasons, out[4].completeness, wide.truncated_at[0].callers_found, wide.truncated_at[0].path) == (20, ["caller-search-truncated"], "PARTIAL", 6, "wide.py")
    assert {k: out[k].reasons for k in range(5, 11)} == {
        5: [bundles.UNRESOLVED], 6: [bundles.UNRESOLVED], 7: [bundles.UNRESOLVED, bundles.OUTSIDE], 8: [bundles.UNRESOLVED, bundles.UNREADABLE], 9: [bundles.UNRESOLVED, bundles.UNREADABLE], 10: [bundles.UNRESOLVED, bundles.UNREADABLE],
    }
    assert out[9].file_class == "TEST" and {r.completeness for k, r in out.items() if k > 4} == {"INSUFFICIENT"}


def test_difference(spark):
    a = spark.createDataFrame([("x", '{"a": 8.0, "b": null, "c": [], "d": [1]}'), ("y", "{")], "id string, raw string")
    b = spark.createDataFrame([("x", '{"a": 8, "c": [], "d": [1, 2], "e": -0.0}'), ("y", "{")], "id string, raw string")
    got = {(r.id, r.pointer): r.change for r in canonical.difference(a, b).collect()}
    assert got == {("x", "/b"): "lost", ("x", "/d/#"): "changed", ("x", "/d/1"): "added", ("x", "/e"): "added"}


@pytest.mark.parametrize("path,ok", [("a/b.py", True), ("a/../b.py", True), ("../b.py", False), ("a/../../b", False), ("/etc/x", False), ("C:/x", False), ("", False), (".", False), (None, False)])
def test_path_safety(spark, path, ok):
    assert (spark.range(1).select(paths.refusal(F.lit(path).cast("string"))).first()[0] is None) is ok


def test_reports(spark):
    t = spark.createDataFrame([("TRUE_POSITIVE", 0.5, 10, 0, 1, "r", "u", 3, 0.9, "j")], "verdict string, cost_usd double, latency_ms long, run_index int, result_index int, rule_id string, uri string, start_line int, confidence double, justification string")
    r = reports.run_report(t, {"model": "m"})
    x = json.loads(r.first().report)
    assert x["verdicts"] == {"TRUE_POSITIVE": 1, "FALSE_POSITIVE": 0, "NEEDS_HUMAN_REVIEW": 0} and x["total"] == 1 and x["stamps"] == {"model": "m"}
    assert {k.key: k.value for k in reports.outputs(r).collect()}["true_positive"] == "1"
    text = reports.comment(t, 0.5).first().text
    assert text.startswith(reports.MARKER) and "- `r` at `u:3` (confidence 0.90) - j" in text and "_None._" in text
    c = spark.createDataFrame([("p", 1, "hello")], "key string, id long, text string")
    once = reports.upsert(c, "p", text)
    assert once.count() == 2 and reports.upsert(once, "p", text + "!").filter("text LIKE '%!'").count() == 1
