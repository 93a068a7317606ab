"""Writers: parquet, relational tables, queues, several sinks (SNK-01..03, 08, 19, 21, 22)."""

from __future__ import annotations

import concurrent.futures
import uuid
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, functions as F

from ..model import ACTIVE, ID, OP, UID
from ..operators.changes import SKIP, merge_latest, plan_split_upsert, with_active


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: Sequence[str] = (), max_records: int | None = None) -> None:
    """SNK-01: parquet; overwrite unless another mode is given."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    writer.parquet(path)


def _statements(spark, url: str, properties: Mapping[str, str], sql: Sequence[str]) -> list[int]:
    """Run statements in one transaction over the session's own JDBC classes (driver side).

    Only statements and row counts pass here; rows go from the tasks to the store.
    """
    jvm = spark._jvm
    if properties.get("driver"):
        jvm.java.lang.Class.forName(properties["driver"], True,
                                    jvm.java.lang.Thread.currentThread().getContextClassLoader())
    props = jvm.java.util.Properties()
    for k, v in properties.items():
        if k != "driver":
            props.setProperty(k, v)
    conn = jvm.java.sql.DriverManager.getConnection(url, props)
    try:
        conn.setAutoCommit(False)
        counts = []
        for text in sql:
            statement = conn.createStatement()
            counts.append(statement.executeUpdate(text))
            statement.close()
        conn.commit()
        return counts
    except Exception:
        conn.rollback()
        raise
    finally:
        conn.close()


def write_jdbc(df: DataFrame, url: str, table: str, keys: Sequence[str], mutation: str = "iud",
               properties: Mapping[str, str] | None = None, batch_size: int = 1000,
               rename: Mapping[str, str] | None = None, dialect: str = "merge",
               sequence: tuple[str, str] | None = None) -> None:
    """SNK-02, SNK-19: write changes to a relational table.

    ``mutation="i"``: plain inserts.  ``"iud"``: the newest row per key goes to a
    staging table, and one ``MERGE`` in the store inserts it or, when its version is
    greater, updates it - idempotent, so a lost executor or a repeated batch does no
    harm.  Deletes set the live flag.  ``dialect="upsert"`` is a blind ``UPSERT``.
    ``rename`` renames system columns; ``sequence`` = (column, next-value expression)
    fills a sequence column on insert.
    """
    properties = dict(properties or {})
    spark, rename = df.sparkSession, dict(rename or {})
    rows = with_active(df if mutation == "i" else merge_latest(df, keys)).drop(UID)
    version = rename.get(ID, ID)
    for old, new in rename.items():
        rows = rows.withColumnRenamed(old, new)
    options = {**properties, "batchsize": str(batch_size)}
    if mutation == "i":
        rows.write.jdbc(url, table, mode="append", properties=options)
        return
    if mutation != "iud":
        raise ValueError(f"unknown mutation {mutation!r}")
    staging = f"{table}_staging_{uuid.uuid4().hex[:12]}"
    rows.write.jdbc(url, staging, mode="overwrite", properties=options)
    q = '"{}"'.format
    columns = rows.columns
    names = ", ".join(map(q, columns))
    if dialect == "upsert":
        sql = [f"UPSERT INTO {table} ({names}) SELECT {names} FROM {staging}"]
    else:
        on = " AND ".join(f"t.{q(k)} = s.{q(k)}" for k in keys)
        sets = ", ".join(f"{q(c)} = s.{q(c)}" for c in columns if c not in keys)
        extra = [(q(sequence[0]), sequence[1])] if sequence else []
        into = ", ".join([e[0] for e in extra] + [q(c) for c in columns])
        values = ", ".join([e[1] for e in extra] + [f"s.{q(c)}" for c in columns])
        sql = [f"MERGE INTO {table} t USING {staging} s ON {on} "
               f"WHEN MATCHED AND (t.{q(version)} IS NULL OR s.{q(version)} > t.{q(version)}) "
               f"THEN UPDATE SET {sets} "
               f"WHEN NOT MATCHED THEN INSERT ({into}) VALUES ({values})"]
    _statements(spark, url, properties, [*sql, f"DROP TABLE {staging}"])


def write_jdbc_split(df: DataFrame, url: str, master: str, meta: str, keys: Sequence[str],
                     properties: Mapping[str, str] | None = None, batch_size: int = 1000) -> None:
    """SNK-03: master rows with physical deletes, versions and live flags in a second table.

    The plan (CDC-08) is staged once; the store then changes both tables in one
    transaction.
    """
    properties = dict(properties or {})
    spark = df.sparkSession
    master_df = spark.read.jdbc(url, master, properties=properties)
    meta_df = spark.read.jdbc(url, meta, properties=properties)
    plan = plan_split_upsert(df, master_df, meta_df, keys).filter(F.col("action") != SKIP)
    staged = plan.withColumn(ACTIVE, F.when(F.col(OP).isin("i", "u"), 1).otherwise(0)) \
        .drop(OP, UID, "action")
    staging = f"{master}_staging_{uuid.uuid4().hex[:12]}"
    staged.write.jdbc(url, staging, mode="overwrite",
                      properties={**properties, "batchsize": str(batch_size)})
    q = '"{}"'.format
    on = " AND ".join(f"s.{q(k)} = {{t}}.{q(k)}" for k in keys)

    def refill(table: str, columns: Sequence[str], only_live: bool) -> list[str]:
        names = ", ".join(map(q, columns))
        live = f" WHERE {q(ACTIVE)} = 1" if only_live else ""
        return [f"DELETE FROM {table} WHERE EXISTS (SELECT 1 FROM {staging} s "
                f"WHERE {on.format(t=table)})",
                f"INSERT INTO {table} ({names}) SELECT {names} FROM {staging}{live}"]

    _statements(spark, url, properties,
                [*refill(master, master_df.columns, True), *refill(meta, meta_df.columns, False),
                 f"DROP TABLE {staging}"])


def write_stream_messages(df: DataFrame, options: Mapping[str, str], format_: str = "kafka"
                          ) -> None:
    """SNK-08: write ``key`` / ``value`` (and ``topic``) columns to a queue."""
    columns = [c for c in ("topic", "key", "value") if c in df.columns]
    df.select(*columns).write.format(format_).options(**options).save()


SINKS: dict[str, Callable[..., Any]] = {}


def register_sink(name: str, fn: Callable[..., Any] | None = None):
    """SNK-22: register ``fn(df, sink)`` under a name; usable as a decorator."""
    if fn is None:
        return lambda f: register_sink(name, f)
    SINKS[name] = fn
    return fn


class SinkError(RuntimeError):
    """One or more sinks failed; ``failures`` maps sink names to errors."""

    def __init__(self, failures: dict[str, Exception]):
        super().__init__(f"sinks failed: {', '.join(failures)}")
        self.failures = failures


def write_all(df: DataFrame, sinks: Mapping[str, Callable[[DataFrame], Any]],
              parallel: bool = False) -> None:
    """SNK-21: the same rows to several sinks; all are tried, then any failure raises.

    The frame is cached on disk-backed storage so that its plan runs once.
    """
    cached = df.persist()
    failures: dict[str, Exception] = {}

    def attempt(name: str) -> None:
        try:
            sinks[name](cached)
        except Exception as e:  # every sink must get its turn
            failures[name] = e

    try:
        if parallel:
            with concurrent.futures.ThreadPoolExecutor(max_workers=len(sinks) or 1) as pool:
                list(pool.map(attempt, sinks))
        else:
            for name in sinks:
                attempt(name)
    finally:
        cached.unpersist()
    if failures:
        raise SinkError(failures)
