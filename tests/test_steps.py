"""Neutral snapshots, run rows with absent and wrong fields, estimates."""

import json

import pytest

from tarnwork.operators import costs, snapshots
from tarnwork.sources import tables

TP = 'def tp_open(p):\n    """tp_open"""\n    return open(p)  # finding: TP\n\ndef tp_other():\n    return tp_open(1)\n'
FP = "import re\ndef fp_open(p):\n    return open(clean(p))  # finding: FP\n"


def test_names_do_not_tell_labels(spark, tmp_path):
    twins = spark.createDataFrame([(f"n{k}.py", TP, FP) for k in range(20)] + [("bad.py", "def (", FP), ("none.py", "x = 1\n", FP), ("null.py", None, FP)], "name string, tp_code string, fp_code string")
    built = snapshots.snapshots(twins).cache()
    out = {r.name: r for r in built.collect()}
    assert [n for n, r in out.items() if r.problem] == ["bad.py", "none.py", "null.py"] and out["none.py"].body is None
    good = [r for r in out.values() if not r.problem]
    assert len({r.body for r in good}) == 2
    for r in good:
        lines = r.body.split("\n")
        assert lines[r.tp_line - 1].strip() == "return open(p)" and lines[r.fp_line - 1].strip() == "return open(clean(p))"
        assert "finding" not in r.body and "fp_" not in r.body and r.body.index("def alpha_open") < r.body.index("def beta_open")
        # strings and later definitions stay
        assert '"""tp_open"""' in r.body and "def tp_other" in r.body and ("return alpha_open(1)" in r.body or "return beta_open(1)" in r.body)
    snapshots.write(built, str(tmp_path / "set"))
    assert sorted(p.name for p in (tmp_path / "set" / "snapshots").iterdir()) == sorted(r.name for r in good)
    assert (tmp_path / "set" / "snapshots" / "n0.py").read_text() == out["n0.py"].body + "\n"
    rows = spark.read.json(str(tmp_path / "set" / "dataset")).collect()
    assert len(rows) == 40 and all(r.line == getattr(out[r.path.split("/")[1]], "tp_line" if r.ground_truth == "TRUE_POSITIVE" else "fp_line") for r in rows)


def test_absent_fields_take_their_defaults(spark, tmp_path):
    rows = [{"id": "a", "verdict": "TRUE_POSITIVE"}, {"id": "b", "verdict": "FALSE_POSITIVE", "completeness": None, "schema_valid": False, "cost_usd": 1, "latency_ms": 7, "other": []}]
    (tmp_path / "rows.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    got = {r.id: r for r in tables.run_rows(spark, str(tmp_path / "rows.jsonl")).collect()}
    assert (got["a"].schema_valid, got["a"].cost_usd, got["a"].latency_ms, got["a"].completeness) == (True, 0.0, 0, None)
    assert (got["b"].schema_valid, got["b"].cost_usd, got["b"].latency_ms) == (False, 1.0, 7)
    assert tables.run_rows(spark, str(tmp_path / "gone.jsonl")).count() == 0


@pytest.mark.parametrize("more", [{"id": ""}, {"id": 3}, {"id": None}, {"verdict": "no"}, {"verdict": None}, {"completeness": "x"}, {"completeness": 1}, {"schema_valid": None}, {"schema_valid": "true"}, {"cost_usd": None}, {"cost_usd": True}, {"cost_usd": "1"}, {"latency_ms": 1.5}, {"latency_ms": True}])
def test_wrong_fields_are_named(spark, tmp_path, more):
    lines = spark.createDataFrame([(json.dumps({"id": "a", "verdict": "TRUE_POSITIVE"} | more),)], "value string")
    assert tables.checked_runs(lines).first().problem == next(iter(more))


def test_a_bad_row_fails_the_read(spark, tmp_path):
    (tmp_path / "rows.jsonl").write_text('{"id": "a", "verdict": "TRUE_POSITIVE"}\n{"id": "b"}\n')
    with pytest.raises(Exception, match="run row of b has no usable verdict"):
        tables.run_rows(spark, str(tmp_path / "rows.jsonl")).collect()


def test_flat_estimate(spark):
    one = costs.flat_estimate(spark.range(103), "large").first()
    assert (one.calls, one.input_tokens, one.output_tokens, round(one.cost_usd, 4)) == (103, 309_000, 41_200, 2.575)
