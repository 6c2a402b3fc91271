"""What Python workers need to know of the driver."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from the folder it is in, where it isn't installed."""
    env, home = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (home, env.get("PYTHONPATH", "")) if x)


def _shared(spark: SparkSession) -> str | None:
    """The folder of checkpoints, set from spark.checkpoint.dir where it isn't yet; none where that isn't set."""
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            return None
        spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """A table that is read several times: written to the folder of spark.checkpoint.dir, or cached where none is set."""
    return df.checkpoint(eager=True) if _shared(df.sparkSession) else df.persist()


def written(df: DataFrame) -> DataFrame:
    """A large table that is read several times, as compressed columns in the folder of checkpoints, or cached where there is none.

    A tenth of what a checkpoint takes; the files go when the driver ends. Shuffles of the plan that made it are of no more
    use: a collection lets Spark's cleaner delete them now instead of at the driver's next one. Just after a plan's end
    listeners may still hold it, so that there is one before the next plan too.
    """
    spark, folder = df.sparkSession, _shared(df.sparkSession)
    if folder is None:
        return df.persist()
    at = f"{folder}/written-{uuid.uuid4().hex}"
    spark._jvm.System.gc()
    df.write.parquet(at)
    files = spark._jvm.org.apache.hadoop.fs.Path(at)
    files.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(files)
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(at)
