"""Streaming sources (SRC-14)."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: columns of a log stream
LOG_COLUMNS = ("key", "value", "topic", "partition", "offset")


def stream_source(spark: SparkSession, topics: Sequence[str], servers: str,
                  starting: Mapping[str, Mapping[int, int]] | str = "earliest",
                  options: Mapping[str, str] | None = None) -> DataFrame:
    """SRC-14: Kafka topics as (key, value, topic, partition, offset), key and value as text.

    ``starting`` is ``earliest``, ``latest`` or offsets per topic and partition.  After
    the first run the checkpoint decides.
    """
    start = starting if isinstance(starting, str) else json.dumps(
        {t: {str(p): o for p, o in ps.items()} for t, ps in starting.items()})
    raw = spark.readStream.format("kafka") \
        .option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)) \
        .option("startingOffsets", start).options(**(options or {})).load()
    return raw.select(F.col("key").cast("string"), F.col("value").cast("string"),
                      "topic", "partition", "offset")


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str, pattern: str = "*",
                files_per_batch: int | None = None) -> DataFrame:
    """A parquet folder as a stream, oldest file first."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)
