"""The query registry and the inputs shared by registered queries.

Every input is one of the given tables, or an expression over its rows.  ``SQL_*``
are the same inputs for the comparison queries.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..model import Field

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under a name, with its SQL when there is one."""
    def register(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _plain_times(fn(spark, sf_dir))

        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def _plain_times(df: DataFrame) -> DataFrame:
    """Times as wall-clock values, as the tables hold them."""
    if not any(isinstance(f.dataType, T.TimestampType) for f in df.schema.fields):
        return df
    return df.select(*[F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name)
                       if isinstance(f.dataType, T.TimestampType) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- F1: a change log ----------------------------------------------------------------

SQL_CHANGES = """changes AS (
  SELECT event_id AS ums_id_, ts AS ums_ts_,
         CASE WHEN event_id % 10 = 9 THEN 'd' WHEN event_id % 10 >= 5 THEN 'u' ELSE 'i' END AS ums_op_,
         CAST(event_id AS VARCHAR) AS ums_uid_, user_id AS k, event_type AS value1,
         value AS value2, props
  FROM events)"""


def changes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    last = F.col("event_id") % 10
    return e.select(
        F.col("event_id").alias("ums_id_"), F.col("ts").cast("timestamp").alias("ums_ts_"),
        F.when(last == 9, "d").when(last >= 5, "u").otherwise("i").alias("ums_op_"),
        F.col("event_id").cast("string").alias("ums_uid_"), F.col("user_id").alias("k"),
        F.col("event_type").alias("value1"), F.col("value").alias("value2"), "props")


# -- F2: keyed messages, one tuple each ------------------------------------------------

FIELDS = [Field("ums_id_", "long", False), Field("ums_ts_", "datetime", False),
          Field("ums_op_", "string", False), Field("k", "long", False), Field("value1", "string")]
NAMESPACE = "kafka.k01.db.events.1.0."


def messages(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    ns = F.concat(F.lit(NAMESPACE), (F.col("user_id") % 4).cast("string"))
    schema = F.struct(ns.alias("namespace"), F.array(*[
        F.struct(F.lit(f.name).alias("name"), F.lit(f.type).alias("type"),
                 F.lit(f.nullable).alias("nullable")) for f in FIELDS]).alias("fields"))
    cells = F.array(F.col("event_id").cast("string"),
                    F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("i"),
                    F.col("user_id").cast("string"), F.col("event_type"))
    body = F.to_json(F.struct(
        F.struct(F.lit("data_increment_data").alias("type")).alias("protocol"),
        schema.alias("schema"), F.array(F.struct(cells.alias("tuple"))).alias("payload")))
    return e.select(F.concat(F.lit("data_increment_data."), ns).alias("key"),
                    body.alias("value"))


# -- F3: change log by user and day, and the table it was loaded into at some time -------

DAY_KEYS = ["k", "day"]
LOADED_AT = "2024-01-16 12:00:00"

SQL_DAYS = SQL_CHANGES + """, days AS (
  SELECT ums_id_, ums_ts_, ums_op_, k, strftime(ums_ts_, '%Y-%m-%d') AS day, value1, value2
  FROM changes)"""

SQL_TARGET = SQL_DAYS + f""", target AS (
  SELECT ums_id_, ums_ts_, k, day, value1, value2,
         CASE WHEN ums_op_ = 'd' THEN 0 ELSE 1 END AS ums_active_
  FROM (SELECT *, row_number() OVER (PARTITION BY k, day ORDER BY ums_id_ DESC) AS rn
        FROM days WHERE ums_ts_ <= TIMESTAMP '{LOADED_AT}') t
  WHERE rn = 1),
latest AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY k, day ORDER BY ums_id_ DESC) AS rn FROM days) t
  WHERE rn = 1)"""


def days(spark: SparkSession, sf: str) -> DataFrame:
    return changes(spark, sf).select(
        "ums_id_", "ums_ts_", "ums_op_", "k", F.date_format("ums_ts_", "yyyy-MM-dd").alias("day"),
        "value1", "value2")


def target(spark: SparkSession, sf: str) -> DataFrame:
    """The table as it stood at ``LOADED_AT``."""
    from ..operators.changes import to_target
    return to_target(days(spark, sf).filter(F.col("ums_ts_") <= F.lit(LOADED_AT)), DAY_KEYS)
