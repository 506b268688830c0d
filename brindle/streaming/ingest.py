"""Resuming: only what has no output yet, as an anti join over a batch or as a stream over new files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def unprocessed(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Inputs without an output; rows of failed outputs count as processed only if outputs holds them."""
    return inputs.join(outputs.select(key).distinct(), key, "left_anti")


def ingest_new(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, step: Callable[[DataFrame], DataFrame], file_format: str = "parquet") -> StreamingQuery:
    """Takes what is new below source through step to target, once; a later call goes on from the checkpoint."""
    stream = step(spark.readStream.format(file_format).schema(schema).load(source))
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
