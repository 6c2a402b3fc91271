"""Replies that are kept by a key of all they depend on: what has a reply already isn't asked again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sorted_fields(value: Column, kind: T.DataType) -> Column:
    """The value with the fields of its objects in the order of their names, at every depth; maps by their keys."""
    if isinstance(kind, T.StructType):
        parts = [sorted_fields(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(value.isNotNull(), F.struct(*parts)) if parts else value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: sorted_fields(x, kind.elementType))
    if isinstance(kind, T.MapType):
        pair = lambda e: F.struct(e["key"].cast("string").alias("key"), sorted_fields(e["value"], kind.valueType).alias("value"))
        return F.map_from_entries(F.array_sort(F.transform(F.map_entries(value), pair)))
    return value


def canonical_json(rows: DataFrame, columns: list[str]) -> Column:
    """JSON of some columns whose text doesn't depend on the order of columns or fields; nulls are written."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    return F.to_json(F.struct(*[sorted_fields(F.col(f"`{c}`"), kinds[c]).alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def keyed(rows: DataFrame, columns: list[str], models: list[str], temperature: float, prompts: dict[str, str], version: str, key: str = "cache_key") -> DataFrame:
    """Adds the key: SHA-256 of the rows' columns and of what a run is done with (models, temperature, prompts' hashes, version)."""
    run = F.struct(
        F.array(*[F.lit(m) for m in models]).cast("array<string>").alias("models"), F.array(*[F.lit(x) for n in sorted(prompts) for x in (n, prompts[n])]).cast("array<string>").alias("prompts"),
        F.lit(float(temperature)).alias("temperature"), F.lit(version).alias("version"),
    )
    # two texts apart by their lengths, so that neither can stand for a part of the other
    body, how = canonical_json(rows, columns), F.to_json(run)
    return rows.withColumn(key, F.sha2(F.concat(F.length(body).cast("string"), F.lit(":"), body, how), 256))


class ReplyCache:
    """Replies in a folder of Parquet files by key. Files of an append appear when its job commits, or not at all."""

    def __init__(self, spark, folder: str, schema: str, key: str = "cache_key"):
        self.spark, self.folder, self.key = spark, folder, key
        self.schema = f"{key} string, {schema}"

    def rows(self) -> DataFrame:
        """All replies, one for each key: the least, should two runs have answered one request at a time."""
        try:
            held = self.spark.read.schema(self.schema).parquet(self.folder)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.schema)
        value = F.struct(*[c for c in held.columns if c != self.key])
        return held.groupBy(self.key).agg(F.min_by(value, F.to_json(value, {"ignoreNullFields": "false"})).alias("_v")).select(self.key, "_v.*")

    def unseen(self, requests: DataFrame) -> DataFrame:
        """Requests that have no reply, one for each key."""
        return requests.join(self.rows().select(self.key), self.key, "left_anti").dropDuplicates([self.key])

    def answer(self, requests: DataFrame, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Every request with its reply: ``ask`` gets the unseen ones and gives their replies (key and the cache's columns).

        Replies are appended before they are used, so that a run that ends early has them next time.
        """
        columns = T.StructType.fromDDL(self.schema).names
        ask(self.unseen(requests)).select(*columns).write.mode("append").parquet(self.folder)
        return requests.join(self.rows(), self.key, "left")
