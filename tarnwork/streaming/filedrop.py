"""Scanner logs as they arrive: a folder as a stream, findings appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions.identity import correlate, tell_apart
from tarnwork.sources.scanlogs import flatten, parse_logs


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.sarif").load(folder)
    return parse_logs(files.select("path", "content"))


def start(spark: SparkSession, folder: str, table_path: str, checkpoint: str, once: bool = True):
    """Appends each batch's identified findings to a Parquet table. Identities depend on a run alone, so batches need no state."""

    def write(logs: DataFrame, number: int):
        out = tell_apart(correlate(flatten(logs))).withColumn("batch", F.lit(number))
        out.write.mode("overwrite").parquet(f"{table_path}/batch={number}")

    stream = log_stream(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()
