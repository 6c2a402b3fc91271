"""Queries over the whole of their tables."""

import os
import re

from tarnwork.plans.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_a_comment_lists_every_finding(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    bodies = [r.body for r in QUERIES["comment_markdown_all"](spark, SF).collect()]
    assert sum(b.count("\n- `") for b in bodies) == sum(int(re.search(r"\((\d+)\)", b)[1]) for b in bodies) == n


def test_reports_cover_every_label(spark):
    n = spark.read.parquet(f"{SF}/labels.parquet").count()
    assert sum(r.n for r in QUERIES["verdict_report_all"](spark, SF).collect()) == QUERIES["run_report_all"](spark, SF).first().total == n
