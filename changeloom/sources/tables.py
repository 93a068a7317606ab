"""Lookup tables and custom sources (SRC-17..19)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

SOURCES: dict[str, Callable[..., DataFrame]] = {}


def jdbc_table(spark: SparkSession, url: str, sql: str, properties: Mapping[str, str] | None = None,
               partition_column: str | None = None, bounds: tuple[int, int] | None = None,
               partitions: int = 1, predicates: Sequence[str] | None = None) -> DataFrame:
    """SRC-17: a user SELECT on a registered connection, labels in lower case.

    Give a partition column with bounds, or predicates, for a parallel read; without
    them the store answers one query to one task.
    """
    reader = spark.read.format("jdbc").options(url=url, **(properties or {}))
    if predicates:
        df = spark.read.jdbc(url, f"({sql}) q", predicates=list(predicates),
                             properties=dict(properties or {}))
    elif partition_column and bounds:
        df = reader.options(dbtable=f"({sql}) q", partitionColumn=partition_column,
                            lowerBound=bounds[0], upperBound=bounds[1],
                            numPartitions=partitions).load()
    else:
        df = reader.option("query", sql).load()
    return df.toDF(*[c.lower() for c in df.columns])


def parquet_table(spark: SparkSession, name: str, path: str) -> DataFrame | None:
    """SRC-18: a parquet folder as a named view; ``None`` while the folder is not ready.

    A join step whose table is ``None`` returns its input unchanged.
    """
    from pyspark.errors import AnalysisException
    try:
        df = spark.read.parquet(path)
    except AnalysisException:
        return None
    df.createOrReplaceTempView(name)
    return df


def register_source(name: str, fn: Callable[..., DataFrame] | None = None):
    """SRC-19: register ``fn(spark, start, end, namespace, connection, options)``; a decorator too."""
    if fn is None:
        return lambda f: register_source(name, f)
    SOURCES[name] = fn
    return fn


def read_source(spark: SparkSession, name: str, start: str | None = None, end: str | None = None,
                namespace: str = "", connection: Any = None,
                options: Mapping[str, Any] | None = None) -> DataFrame:
    """SRC-19: call a registered source."""
    if name not in SOURCES:
        raise ValueError(f"no source {name!r}")
    return SOURCES[name](spark, start, end, namespace, connection, dict(options or {}))
