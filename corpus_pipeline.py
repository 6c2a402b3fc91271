"""The corpus pipeline: quality, repeated lines, near duplicates, mixing, pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.llm.common import table
from tarnwork.llm.lines import keep_fresh
from tarnwork.llm.mixing import take
from tarnwork.llm.neardup import keep_one
from tarnwork.llm.pieces import encode
from tarnwork.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose chance of the top grade is under one half, and those without words (null, empty, blank).

    Equal texts fare alike; without labels of two grades all documents with words stay.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later repeated runs of lines, single ones of 13 words or more too, and documents that lose three
    quarters or more of their bytes and of their lines that way.

    Null, empty and blank texts stay as they are; equal rows are documents of equal rank, so none is the later one.
    """
    return keep_fresh(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates.

    Rows without doc_id stay; null and empty texts are linked with nothing and stay; of rows that repeat a doc_id one stays.
    """
    return keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes words from each source near its target; a document can be there twice, or in part.

    Null is a source of its own; rows without words are left out; equal rows are interchangeable.
    """
    out = take(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of each document; null and empty texts have none, equal rows the same."""
    return encode(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("MinHash near-dedup", near), ("mixing sources to target weights", mixture), ("SentencePiece encoding", segment)]
#: The quality stage has no SQL; the tests hold the stages against plain versions, the quality stage against labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
