"""Incremental runs: new shards only, once each, by Structured Streaming's file source and checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType


def process_new(spark: SparkSession, source: str, schema: StructType, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Transform files of source that no earlier run has seen, append them to sink, and stop; a rerun after a failure repeats nothing."""
    new = spark.readStream.schema(schema).format(fmt).load(source)
    return transform(new).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pending(spark: SparkSession, jobs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Jobs without an output yet."""
    return jobs.join(done, key, "left_anti")
