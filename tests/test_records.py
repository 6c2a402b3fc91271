"""Texts of figures, findings that no budget was left for, and spending by what calls did cost."""

from pyspark.sql import functions as F

from tarnwork.operators import costs, prefilter, records


def test_texts_of_figures(spark):
    df = spark.createDataFrame([(0.1234, 1.5, 12.4), (None, None, None)], "a double, b double, c double")
    got = df.select(records.share_text(F.col("a")), records.money_text(F.col("b")), records.time_text(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [("12.3%", "$1.5000", "12 ms"), ("n/a", "n/a", "n/a")]


def test_only_unjudged_findings_are_marked(spark):
    rows = [("ADJUDICATE", None, "prefilter:pass", "x"), ("ADJUDICATE", "TRUE_POSITIVE", "prefilter:pass", "x"), ("DEDUPLICATED", None, "prefilter:dedupe", "y")]
    out = records.mark_exhausted(spark.createDataFrame(rows, "disposition string, verdict string, resolved_by string, justification string")).collect()
    assert [r.resolved_by for r in out] == [records.EXHAUSTED, "prefilter:pass", "prefilter:dedupe"] and out[0].justification == records.EXHAUSTED_WHY


def test_actual_costs_add_up(spark):
    df = spark.createDataFrame([(0, i, e, a) for i, (e, a) in enumerate([(2.0, 0.5), (3.0, 4.5), (0.1, 0.0), (0.0, 0.0)])], "g int, i int, cost double, paid double")
    allowed = lambda **k: [r.allowed for r in costs.budget_cut(df, ["g"], ["i"], 5.0, **k).orderBy("i").collect()]
    assert allowed() == [True, True, False, False] and allowed(spent="paid") == [True, True, False, False]
    assert [r.allowed for r in costs.budget_cut(df, ["g"], ["i"], 5.2, spent="paid").orderBy("i").collect()] == [True, True, True, True]


def test_classes_of_all_findings(spark):
    df = spark.createDataFrame([("TEST",), ("TEST",), ("SOURCE",)], "file_class string")
    assert {r.file_class: r.n for r in prefilter.by_class(df).collect()} == {"TEST": 2, "SOURCE": 1}
