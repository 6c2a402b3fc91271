"""Extractors as table functions, broken statements, lines of all endings."""

import re

import pytest

from tarnwork.sources import pysource


def test_a_language_of_ones_own(spark):
    def makefile_symbols(path, text):
        return [{"path": path, "kind": "function", "name": m[1], "start_line": text.count("\n", 0, m.start()) + 1, "parsed": True} for m in re.finditer(r"(?m)^(\w+):", text)]

    pysource.register(spark, "make", makefile_symbols)
    files = spark.createDataFrame([("Makefile", "all: x\n\nx:\n\ttouch x\n"), ("none", None)], "path string, text string")
    assert [(r.name, r.start_line) for r in pysource.functions(pysource.symbols(files, "make")).orderBy("start_line").collect()] == [("all", 1), ("x", 3)]
    files.createOrReplaceTempView("files_of_a_test")
    rows = spark.sql("SELECT s.name, s.kind FROM files_of_a_test f, LATERAL make_symbols(f.path, f.text) s ORDER BY s.start_line").collect()
    assert [tuple(r) for r in rows] == [("all", "function"), ("x", "function")]


def test_python_as_a_table_function(spark):
    pysource.register(spark, "python", pysource.symbols_of)
    rows = spark.sql("SELECT name, start_line, text FROM python_symbols('a.py', 'def f():\\n  return g()\\n') WHERE kind <> 'file' ORDER BY start_byte").collect()
    assert [tuple(r) for r in rows] == [("f", 1, "def f():\n  return g()"), ("g", 2, None)]


GOOD = "import os\n\n@d('é')\ndef first(x):\n    return second(x)\n\nclass C:\n    def second(self, y):\n        '''text'''\n        return third((i for i in y), 1)\n"


@pytest.mark.parametrize("broken", ["def third(:\n    pass\n", "x = (1,\n", "if True\n    y = 1\n", "def empty():\n\n", "  unexpected = 1\n", "s = '''open\n", "a b c\n"])
def test_one_broken_statement_leaves_the_rest(broken):
    for text, shift in ((GOOD + "\n" + broken, 0), (broken + "\n" + GOOD, broken.count("\n") + 1)):
        rows = pysource.symbols_of("p", text)
        assert [(r["name"], r["start_line"] - shift, r["end_line"] - shift) for r in rows if r["kind"] == "function" and r["name"] in ("first", "second")] == [("first", 3, 5), ("second", 8, 10)]
        assert [r["parsed"] for r in rows if r["kind"] == "file"] == [False] and any(r["kind"] == "error" for r in rows)
        for r in rows:
            if r["kind"] == "function":
                assert text.encode()[r["start_byte"] : r["end_byte"]].decode() == r["text"]


@pytest.mark.parametrize("end", ["\n", "\r", "\r\n"])
def test_endings_of_lines(end):
    text = GOOD.replace("\n", end)
    rows = pysource.symbols_of("p", text)
    assert [(r["name"], r["start_line"]) for r in rows if r["kind"] == "call"] == [("d", 3), ("second", 5), ("third", 10)]
    second = next(r for r in rows if r["name"] == "second" and r["kind"] == "function")
    assert text.encode()[second["start_byte"] : second["end_byte"]].decode() == second["text"] and second["text"].startswith("def second(self, y):" + end)


def test_what_cannot_be_parsed_at_all():
    for text in ("-" * 200_000, "(" * 5000, "\0", "\ud800", ""):
        assert [r["kind"] for r in pysource.symbols_of("p", text) if r["kind"] not in ("error",)] == ["file"]


def test_bare_generators_are_no_calls():
    calls = lambda text: [r["name"] for r in pysource.symbols_of("p", text) if r["kind"] == "call"]
    assert calls("f(x for x in y)\ng((x for x in y))\nh(x for x in k(y))\n[a](1)\nb.c.d(2)\n") == ["g", "k", "d"]
