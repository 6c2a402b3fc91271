"""Reads of a checkout's files by the URIs of findings; every read is resolved under the checkout's root first.

The root is a folder that all executors see. Files are opened on the executors, one row for each URI, with the text or
the reason why there is none. Nothing is read in part.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions import paths
from tarnwork.functions.workers import importable
from tarnwork.sources import pysource

#: Reasons of files that may be opened and can't be read whole.
MISSING, LARGE, NO_TEXT = "no such file", "over the largest size", "not UTF-8"
LEADS_OUT = "link leads out of its root"


def read_under(root: str, path: str, largest: int = pysource.LARGEST) -> tuple[str | None, str | None, str | None]:
    """(text, refusal, failure) of a path that has passed ``paths.refusal``; links are followed before they are judged."""
    try:
        if not paths.inside(root, path):
            return None, LEADS_OUT, None
        at = os.path.realpath(os.path.join(root, path))
        if not os.path.isfile(at):
            return None, None, MISSING
        with open(at, "rb") as file:
            # one byte more tells a file that is too large, even one that grows meanwhile
            data = file.read(largest + 1)
    except (OSError, ValueError):
        return None, None, MISSING
    if len(data) > largest:
        return None, None, LARGE
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None, None, NO_TEXT
    return text.replace("\r\n", "\n").replace("\r", "\n"), None, None


def read(uris: DataFrame, root: str, largest: int = pysource.LARGEST) -> DataFrame:
    """(path, text, refusal, failure) of every distinct path that ``uris``(uri) name, after F2's normalisation.

    ``refusal`` says why a path isn't opened at all, ``failure`` why there is no text of one that may be.
    """
    return read_paths(uris.filter("uri <> ''").select(paths.normal_uri(F.col("uri")).alias("path")), root, largest)


def read_paths(named: DataFrame, root: str, largest: int = pysource.LARGEST) -> DataFrame:
    """``read`` of relative paths as they are: a percent sign stands for itself."""
    importable(named.sparkSession)
    named = named.select("path").distinct().withColumn("refusal", paths.refusal(F.col("path")))

    def open_all(it: Iterator[pd.DataFrame]):
        for pdf in it:
            rows = [(p, None, no, None) if no is not None else (p, *read_under(root, p, largest)) for p, no in zip(pdf["path"], pdf["refusal"])]
            yield pd.DataFrame(rows, columns=["path", "text", "refusal", "failure"])

    return named.mapInPandas(open_all, "path string, text string, refusal string, failure string")


def project(spark: SparkSession, root: str, most: int = pysource.FILES) -> DataFrame:
    """(path, text) of a project's Python files, the first ``most`` by path, chosen before any is read.

    Vendored and generated ones are left out, and links that lead out. Files over the largest size or of bad UTF-8 have
    null text, never part of it.
    """
    return read_paths(pysource.listing(spark, root, most), root).filter("refusal IS NULL").select("path", "text")


def files_of(spark: SparkSession, root: str, findings: DataFrame, most: int = pysource.FILES) -> DataFrame:
    """(path, text, project, refusal, failure): a project's files and those of findings(uri, ...), each once.

    Project files are the first ``most`` by path, vendored and generated ones left out; paths are relative to the root.
    """
    # links in the project's own list are resolved like any other
    listed = pysource.listing(spark, root, most).select("path")
    named = findings.filter("uri <> ''").select(paths.normal_uri(F.col("uri")).alias("path"))
    every = read_paths(named.unionByName(listed), root)
    return every.join(listed.withColumn("project", F.lit(True)), "path", "left").select("path", "text", F.coalesce("project", F.lit(False)).alias("project"), "refusal", "failure")
