"""Incremental index: new files of a folder are appended once, across restarts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ..operators import catalog


def read_index(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def follow(spark: SparkSession, source: str, schema: T.StructType, index: str, checkpoint: str, key: str = "path", encode: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Appends rows of new Parquet files whose key the index lacks.

    A batch is written to a folder named by its number, so a batch that runs
    again after a failure replaces itself instead of adding rows twice.
    """

    def add(batch: DataFrame, number: int) -> None:
        known = read_index(batch.sparkSession, f"{index}/batch=*", batch.schema).select(key)
        fresh = batch.dropDuplicates([key]).join(known, key, "left_anti")
        encode(fresh).write.mode("overwrite").parquet(f"{index}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert(index: DataFrame, batch: DataFrame, key: str = "path") -> DataFrame:
    return catalog.add_to_index(index, batch, key)
