"""Session and table helpers of the corpus operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions.workers import importable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Most bytes of an Arrow batch, so that tasks don't hold many texts twice.
BATCH = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches; a lower bound that is set already stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = spark.conf.get(name).lower().rstrip("b")
    if not have.isdigit() or not 0 < int(have) <= BATCH:
        spark.conf.set(name, str(BATCH))


def documents(docs: DataFrame) -> DataFrame:
    """The two columns that text operators use; other columns, of whatever name, don't matter."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def partitions(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def cut(df: DataFrame, placed: bool = False) -> DataFrame:
    """Cuts lineage by a reliable checkpoint in the folder that the cluster names in spark.checkpoint.dir.

    ``placed``: the result keeps its hash partitioning and order, so that later joins on the same
    key leave it in place. An adaptive plan doesn't tell them, so this one plan is made without.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tarnwork-"))
    if not placed:
        return df.checkpoint(eager=True)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        # the plan is made anew under this setting
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def cut_small(df: DataFrame, fold: int = 16) -> DataFrame:
    """``cut`` for what is far smaller than the shuffle that made it: one file for ``fold`` partitions.

    The rows are dealt anew, so the stage that makes them keeps its own number of tasks.
    """
    return cut(df.repartition(max(1, partitions(df.sparkSession) // fold)))
