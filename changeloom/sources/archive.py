"""Message archives: writing, pruned reading, versions, CSV (SRC-15, SRC-16, SNK-09, SNK-10)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.times import parse_ts
from ..model import INCREMENT, INITIAL, TS, Field, Namespace
from .messages import ENVELOPE, apply_ums_schema, classify_messages, read_ums

PARTITIONS = ("status", "system", "instance", "db", "tab", "version", "db_partition",
              "table_partition", "protocol")
RIGHT, WRONG = "right", "wrong"
#: stands for a cell that is not there; no text of a message holds this control character
_NO_CELL = "\x00"


def write_archive(df: DataFrame, path: str, key_col: str = "key", value_col: str = "value",
                  max_records: int = 1_000_000, mode: str = "append", writers: int = 8) -> None:
    """SNK-09: raw messages by table name, version, shards and protocol.

    Messages that do not decode go to ``status=wrong``.  ``min_ts`` / ``max_ts`` hold
    each message's event-time range; parquet keeps their file and row-group bounds, so
    they are the manifest.  Files roll by ``max_records`` and are in order of time.  Rows go
    to at most ``writers`` tasks per folder, so a folder gets few files, and a table that
    holds most of the stream does not end in one task.
    """
    m = classify_messages(df.select(F.col(key_col).alias("key"), F.col(value_col).alias("value")),
                          "key", "value")
    # a wrapped line only: text after trimming starts and ends with a brace
    text = F.trim("value")
    m = m.withColumn("_m", F.when(text.startswith("{") & text.endswith("}"),
                                  F.from_json("value", ENVELOPE)))
    position = F.array_position(F.transform("_m.schema.fields", lambda f: F.lower(f["name"])),
                                F.lit(TS)).cast("int") - 1
    times = F.transform("_m.payload", lambda p: parse_ts(F.get(p["tuple"], position)))
    ok = F.col("_m.schema.fields").isNotNull() & F.col("_m.payload").isNotNull()
    parts = F.split("namespace", r"\.")
    names = dict(zip(PARTITIONS[1:8], range(7)))
    out = m.select(
        "key", "value", F.array_min(times).alias("min_ts"), F.array_max(times).alias("max_ts"),
        F.when(F.coalesce(ok, F.lit(False)), RIGHT).otherwise(WRONG).alias("status"),
        *[F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(n) for n, i in names.items()],
        "protocol")
    writer = F.pmod(F.xxhash64("key", "value"), F.lit(writers))
    out = out.repartition(*PARTITIONS, writer).sortWithinPartitions(*PARTITIONS, "min_ts")
    out.write.mode(mode).partitionBy(*PARTITIONS).option("maxRecordsPerFile", max_records) \
        .parquet(path)


def archive_manifest(spark, path: str) -> DataFrame:
    """Per file: event-time range and message count."""
    return spark.read.parquet(path) \
        .groupBy(F.input_file_name().alias("file"), *PARTITIONS) \
        .agg(F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"),
             F.count(F.lit(1)).alias("n"))


def latest_version(archive: DataFrame, folders: Mapping[str, Sequence[str]] | None = None
                   ) -> DataFrame:
    """SRC-16: the messages of the numerically highest version.

    The version is a folder name, so the highest is found among the names of the archive's
    files, which Spark has listed already; no file is read for it.  ``folders`` are the
    other folders in which the files may lie.
    """
    inside = [[f"/{name}={value}/" for value in values] for name, values in (folders or {}).items()]
    versions = {int(found[1]) for file in map(unquote, archive.inputFiles())
                if (found := re.search(r"/version=(\d+)/", file)) 
                and all(any(f in file for f in some) for some in inside)}
    return archive.filter(F.col("version").try_cast("long") == max(versions)) if versions \
        else archive.limit(0)


def read_archive(spark, path: str, namespace: str, fields: Sequence[Field],
                 start: str | None = None, end: str | None = None, initial: bool = True,
                 increment: bool = True) -> DataFrame:
    """SRC-15, SRC-16: typed rows of one table between two times, both ends included.

    Folders are pruned by name, version and protocol; with both bounds, row groups
    whose event-time range misses them are skipped; rows are then filtered.  Version
    ``*`` is the highest one present.
    """
    ns = Namespace.parse(namespace)
    protocols = [p for p, on in ((INITIAL, initial), (INCREMENT, increment)) if on]
    # folder names are text, also where they look like numbers
    folders = T.StructType([T.StructField(c, T.StringType()) for c in ("key", "value")]
                           + [T.StructField(c, T.TimestampType()) for c in ("min_ts", "max_ts")]
                           + [T.StructField(c, T.StringType()) for c in PARTITIONS])
    a = spark.read.schema(folders).parquet(path).filter(
        (F.col("status") == RIGHT) & F.col("protocol").isin(*protocols)
        & (F.col("system") == ns.system) & (F.col("instance") == ns.instance)
        & (F.col("db") == ns.database) & (F.col("tab") == ns.table))
    for column, part in (("db_partition", ns.db_partition),
                         ("table_partition", ns.table_partition)):
        if part != "*":
            a = a.filter(F.col(column) == part)
    inside = {"status": [RIGHT], "system": [ns.system], "instance": [ns.instance],
              "db": [ns.database], "tab": [ns.table], "protocol": protocols} | {
        c: [p] for c, p in (("db_partition", ns.db_partition),
                            ("table_partition", ns.table_partition)) if p != "*"}
    a = latest_version(a, inside) if ns.version == "*" else a.filter(F.col("version") == ns.version)
    low = parse_ts(F.lit(start)) if start else None
    high = parse_ts(F.lit(end)) if end else None
    if low is not None and high is not None:
        a = a.filter((F.col("max_ts") >= low) & (F.col("min_ts") <= high))
    rows = apply_ums_schema(read_ums(a.select("value")), fields)
    if low is not None:
        rows = rows.filter(F.col(TS) >= low)
    if high is not None:
        rows = rows.filter(F.col(TS) <= high)
    return rows


def write_csv_archive(df: DataFrame, path: str, value_col: str = "value",
                      max_records: int = 1_000_000) -> None:
    """SNK-10: one CSV line per tuple under a folder per table, schema text beside it.

    ``data`` holds the lines, ``schema`` one JSON field list per table, ``wrong`` the
    messages that do not decode.
    """
    decoded = read_ums(df, value_col)
    # a line has as many cells as its table has fields: keep the cells as one CSV text
    line = F.array_join(F.transform("tuple", lambda c: F.when(c.isNull(), F.lit(_NO_CELL)).otherwise(
        F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')))), ",")
    decoded.select("namespace", "protocol", line.alias("line")) \
        .write.mode("append").partitionBy("namespace", "protocol") \
        .option("maxRecordsPerFile", max_records).text(f"{path}/data")
    # the first schema of a table counts; the aggregate keeps one text per table and task
    decoded.groupBy("namespace").agg(F.min(F.to_json("fields")).alias("fields")) \
        .write.mode("append").partitionBy("namespace").text(f"{path}/schema")
    from .messages import malformed
    malformed(df, value_col).select(value_col).write.mode("append").text(f"{path}/wrong")


def read_csv_archive(spark, path: str, namespace: str, fields: Sequence[Field]) -> DataFrame:
    """Rows of one table of a CSV archive, typed."""
    from ..functions.casts import try_cast_ums
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in fields])
    folders = [T.StructField(c, T.StringType()) for c in ("namespace", "protocol")]
    # a cell may hold line breaks; an empty one in quotes is a text, without them null
    cells = spark.read.schema(T.StructType([*raw.fields, *folders])).csv(
        f"{path}/data", multiLine=True, escape='"', nullValue=_NO_CELL, emptyValue="") \
        .filter(F.col("namespace") == namespace)
    return cells.select(
        *[try_cast_ums(F.col(f"`{f.name}`"), f.type).alias(f.name) for f in fields])
