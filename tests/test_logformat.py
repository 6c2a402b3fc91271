"""Scanner logs by their own data source: every file a row, every row a file, and nothing left of a failed write."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tarnwork.sources import logformat, scanlogs


def log(k):
    return {"version": "2.1.0", "runs": [{"tool": {"driver": {"name": f"t{k}"}}, "results": [{"message": {"text": "é"}, "properties": {}, "x": None, "y": []} for _ in range(k)]}]}


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for k in range(12):
        (tmp_path / "in" / ("deep" if k % 2 else ".") / f"log{k}.sarif").write_text(json.dumps(log(k), indent=2, ensure_ascii=False) + "\n")
    (tmp_path / "in" / "none.sarif").write_bytes(b"")
    (tmp_path / "in" / "broken.sarif").write_text("{")
    (tmp_path / "in" / "other.txt").write_text("{}")
    return tmp_path


def read(spark, path):
    logformat.register(spark)
    return spark.read.format("scanlogs").load(str(path))


def test_files_of_no_bytes_have_a_row(spark, folder):
    rows = {os.path.basename(r.path): r for r in read(spark, folder / "in").collect()}
    assert len(rows) == 14 and [n for n, r in rows.items() if not r.ok] == ["broken.sarif", "none.sarif"]
    assert rows["none.sarif"].error == "unreadable: JSONDecodeError" and rows["none.sarif"].raw is None
    assert read(spark, folder / "in" / "log0.sarif").count() == 1


def test_files_are_dealt_by_size(folder, monkeypatch):
    monkeypatch.setattr(logformat, "TASK_FILES", 5)
    parts = logformat.LogReader(str(folder / "in")).partitions()
    assert [len(p.paths) for p in parts] == [5, 5, 4]
    monkeypatch.setattr(logformat, "TASK_BYTES", 1)
    assert len(logformat.LogReader(str(folder / "in")).partitions()) == 13


def test_round_trip(spark, folder):
    logs = read(spark, folder / "in").filter("ok").repartition(3)
    logs.write.format("scanlogs").option("root", str(folder / "in")).mode("append").save(str(folder / "out"))
    out = {os.path.relpath(r.path, folder / "out"): r.raw for r in read(spark, folder / "out").collect()}
    assert out == {os.path.relpath(r.path, folder / "in"): r.raw for r in logs.collect()} and len(out) == 12
    assert sorted(os.listdir(folder / "out")) == sorted({n.split("/")[0] for n in out})
    for name in out:
        assert (folder / "out" / name).read_bytes() == (folder / "in" / name).read_bytes()
    notes = spark.createDataFrame([(str(folder / "out" / "log2.sarif"), 0, 1, '{"a":1}', "FALSE_POSITIVE", "j")], "path string, run_index int, result_index int, note string, verdict string, justification string")
    scanlogs.annotate(read(spark, folder / "out"), notes).withColumns({"ok": F.lit(True), "error": F.lit(None).cast("string")}).select("path", "ok", "error", "raw").write.format("scanlogs").option("root", str(folder / "out")).mode("overwrite").save(str(folder / "out"))
    again = {os.path.relpath(r.path, folder / "out"): r.raw for r in read(spark, folder / "out").collect()}
    assert [n for n in again if again[n] != out[n]] == ["log2.sarif"] and '"suppressions"' in again["log2.sarif"]


@pytest.mark.parametrize("bad", ["../up.sarif", "/abs.sarif", "same.sarif", None])
def test_nothing_is_left_of_a_failed_write(spark, folder, bad):
    rows = [(f"a{k}.sarif", True, None, "{}") for k in range(20)] + [("same.sarif", True, None, "{}"), (bad or "null.sarif", True, None, "{}" if bad else None)]
    logformat.register(spark)
    with pytest.raises(Exception):
        spark.createDataFrame(rows, scanlogs.LOGS).repartition(4).write.format("scanlogs").mode("append").save(str(folder / "failed"))
    assert not (folder / "failed").exists() or os.listdir(folder / "failed") == []


def test_existing_files_are_not_replaced_by_an_append(spark, folder):
    logformat.register(spark)
    rows = spark.createDataFrame([("log1.sarif", True, None, "{}")], scanlogs.LOGS)
    rows.write.format("scanlogs").mode("append").save(str(folder / "x"))
    with pytest.raises(Exception):
        rows.withColumn("raw", F.lit("{ }")).write.format("scanlogs").mode("append").save(str(folder / "x"))
    assert (folder / "x" / "log1.sarif").read_text() == "{}"
