"""Sinks and output shaping: SNK-*."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, functions as F

from ..operators.changes import SKIP, plan_upsert
from ..session import shared_dir
from ..sinks.encode import (Leaf, Obj, Route, message_keys, route, to_flat_json, to_nested_json,
                            to_ums)
from ..sinks.shape import (document_upserts, newer_than_stored, to_documents, to_hashes, to_puts,
                           to_requests, to_shards)
from ..sinks.write import write_parquet
from ..sources.archive import (archive_manifest, read_csv_archive, write_archive,
                               write_csv_archive)
from ..model import Field
from ..sources.messages import apply_ums_schema, read_ums
from .base import (DAY_KEYS, FIELDS, SQL_CHANGES, SQL_TARGET, changes, days, messages, query,
                   target)

W = "WITH " + SQL_CHANGES
WT = "WITH " + SQL_TARGET


@query("snk_01_write_parquet", f"{W} SELECT ums_id_, k, value1, value2 FROM changes")
def snk_01(spark, sf):
    path = shared_dir(spark, "table")
    df = changes(spark, sf).select("ums_id_", "k", "value1", "value2")
    write_parquet(df, path, partition_by=["value1"], max_records=1_000_000)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)


@query("snk_04_to_ums_round_trip", f"""{W}
    SELECT ums_id_, date_trunc('milliseconds', ums_ts_) AS ums_ts_, ums_op_, k, value1, value2 FROM changes""")
def snk_04(spark, sf):
    df = changes(spark, sf).select("ums_id_", "ums_ts_", "ums_op_", "k", "value1", "value2")
    sent = to_ums(df, "kafka.k01.db.events.*.*.*")
    return apply_ums_schema(read_ums(sent), [*FIELDS, Field("value2", "double")])


@query("snk_04_to_ums_packing", f"""{W}
    SELECT CAST(count(*) AS BIGINT) AS n_rows, 50 AS fullest, TRUE AS keyed FROM changes""")
def snk_04_packing(spark, sf):
    sent = to_ums(changes(spark, sf), "kafka.k01.db.events.*.*.*")
    size = F.expr("json_array_length(get_json_object(value, '$.payload'))")
    return sent.agg(F.sum(size).cast("long").alias("n_rows"), F.max(size).alias("fullest"),
                    F.bool_and(F.startswith("key", F.lit("data_increment_data.kafka.k01.db.events.")))
                    .alias("keyed"))


@query("snk_05_flat_json", f"""{W}
    SELECT '{{"namespace":"a.b.c.d","protocol":"data_increment_data","ums_id_":' || CAST(ums_id_ AS VARCHAR) || ',"ums_op_":"' || ums_op_
      || '","k":' || COALESCE(CAST(CASE WHEN value1 <> 'view' THEN k END AS VARCHAR), 'null') || ',"value1":"' || value1 || '"}}' AS value FROM changes""")
def snk_05(spark, sf):
    df = changes(spark, sf).select("ums_id_", "ums_op_", F.when(
        F.col("value1") != "view", F.col("k")).alias("k"), "value1")
    return to_flat_json(df, "a.b.c.d")


@query("snk_06_flat_json_plain", f"""{W}
    SELECT '{{"k":' || CAST(k AS VARCHAR) || ',"value1":"' || value1 || '"}}' AS value FROM changes""")
def snk_06(spark, sf):
    return to_flat_json(changes(spark, sf).select("ums_id_", "ums_op_", "k", "value1"),
                        system=False)


@query("snk_07_nested_json", f"""{W}
    SELECT '{{"id":' || CAST(ums_id_ AS VARCHAR) || ',"body":{{"kind":"' || value1 || '","none":null}},"ums_active_":'
      || CASE WHEN ums_op_ = 'd' THEN '0' ELSE '1' END || '}}' AS value FROM changes""")
def snk_07(spark, sf):
    return to_nested_json(changes(spark, sf), [
        Leaf("id", column="ums_id_"), Obj("body", [Leaf("kind", column="value1"),
                                                   Leaf("none", "int")]), Leaf("ums_op_")])


@query("snk_08_message_keys", f"""{W}
    SELECT 'data_increment_data.a.b.c.d.1.0.0...' || md5('{{"k":' || CAST(k AS VARCHAR) || ',"value1":"' || value1 || '"}}') AS key,
           '{{"k":' || CAST(k AS VARCHAR) || ',"value1":"' || value1 || '"}}' AS value FROM changes""")
def snk_08(spark, sf):
    return message_keys(to_flat_json(changes(spark, sf).select("k", "value1"), system=False),
                        "a.b.c.d.1.0.0").select("key", "value")


@query("snk_09_archive_manifest", """
    SELECT status, tab, table_partition, min(ts) AS min_ts, max(ts) AS max_ts, count(*) AS n FROM (
      SELECT CASE WHEN event_type = 'error' THEN 'wrong' ELSE 'right' END AS status, 'events' AS tab,
             CAST(user_id % 4 AS VARCHAR) AS table_partition,
             CASE WHEN event_type <> 'error' THEN date_trunc('milliseconds', ts) END AS ts FROM events) t
    GROUP BY status, tab, table_partition""")
def snk_09(spark, sf):
    # the messages of one event type are cut short
    m = messages(spark, sf)
    m = m.withColumn("value", F.when(F.contains("value", F.lit('"error"')),
                                     F.substring("value", 1, 40)).otherwise(F.col("value")))
    path = shared_dir(spark, "archive")
    write_archive(m, path)
    return archive_manifest(spark, path).groupBy(
        "status", "tab", F.col("table_partition").cast("string").alias("table_partition")) \
        .agg(F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"),
             F.sum("n").alias("n"))


@query("snk_10_csv_archive", """
    SELECT event_id AS ums_id_, date_trunc('milliseconds', ts) AS ums_ts_, 'i' AS ums_op_, user_id AS k, event_type AS value1
    FROM events""")
def snk_10(spark, sf):
    path = shared_dir(spark, "csv")
    write_csv_archive(messages(spark, sf), path)
    tables = [read_csv_archive(spark, path, f"kafka.k01.db.events.1.0.{n}", FIELDS)
              for n in range(4)]
    return functools.reduce(DataFrame.unionByName, tables)


@query("snk_11_route", """
    WITH m AS (SELECT user_id % 4 AS g, event_id FROM events),
    c AS (SELECT 'copy' AS topic, 'mysql.m1.x.y.1.0.' || CAST(g AS VARCHAR) AS ns, event_id FROM m
          UNION ALL SELECT 'two', 'kafka.k02.db.two.7.0.2', event_id FROM m)
    SELECT topic, 'data_increment_data.' || ns AS key, ns AS body_ns, event_id FROM c""")
def snk_11(spark, sf):
    out = route(messages(spark, sf), [
        Route("kafka.k01.db.events.*.*.*", "mysql.m1.x.y.*.*.*", "copy"),
        Route("kafka.k01.db.events.*.*.*", "kafka.k02.db.two.7.0.2", "two"),
        Route("kafka.k01.db.other.*.*.*", "never.n.n.n.*.*.*", "never")])
    return out.select("topic", "key", F.get_json_object("value", "$.schema.namespace")
                      .alias("body_ns"), F.get_json_object("value", "$.payload[0].tuple[0]")
                      .cast("long").alias("event_id"))


@query("snk_12_to_documents", f"""{W}
    SELECT CAST(k AS VARCHAR) || '_' || ums_uid_ AS _id,
           '{{"ums_id_":' || CAST(ums_id_ AS VARCHAR) || ',"k":' || CAST(k AS VARCHAR) || ',"ums_uid_":"' || ums_uid_ || '","n":'
           || CASE WHEN value1 = 'view' THEN 'null' ELSE CAST(k AS VARCHAR) END || ',"ums_active_":' || CASE WHEN ums_op_ = 'd' THEN '0' ELSE '1' END || '}}' AS document
    FROM changes""")
def snk_12(spark, sf):
    df = changes(spark, sf).select("ums_id_", "ums_op_", "k", "ums_uid_", F.when(
        F.col("value1") == "view", " ").otherwise(F.col("k").cast("string")).alias("n"))
    return to_documents(df, ["k", "ums_uid_"], {"n": "long"})


_UPSERTS = f"""{WT}
    SELECT l.k, l.day, l.ums_id_, CASE WHEN t.k IS NULL THEN 'i' ELSE 'u' END AS action
    FROM latest l LEFT JOIN target t ON l.k = t.k AND l.day = t.day WHERE t.k IS NULL OR l.ums_id_ > t.ums_id_"""


@query("snk_13_document_upserts", _UPSERTS)
def snk_13(spark, sf):
    return document_upserts(days(spark, sf), target(spark, sf), DAY_KEYS) \
        .select("k", "day", "ums_id_", "action")


@query("snk_14_to_puts", f"""{WT}
    SELECT md5(CAST(l.k AS VARCHAR)) || '_' || l.day AS rowkey, l.ums_id_ AS version, l.value1 AS kind,
           CASE WHEN l.ums_op_ = 'd' THEN '0' ELSE '1' END AS active
    FROM latest l LEFT JOIN target t ON l.k = t.k AND l.day = t.day WHERE t.k IS NULL OR l.ums_id_ > t.ums_id_""")
def snk_14(spark, sf):
    puts = to_puts(days(spark, sf), "md5(k) + '_' + day", stored=target(spark, sf), keys=DAY_KEYS)
    return puts.select("rowkey", "version", F.col("cells")["cf:value1"].alias("kind"),
                       F.col("cells")["cf:ums_active_"].alias("active"))


@query("snk_15_to_hashes", f"""{WT}
    SELECT 't:' || CAST(l.k AS VARCHAR) || '_' || l.day AS key, l.value1 AS kind, CAST(l.ums_id_ AS VARCHAR) AS id, 60 AS ttl
    FROM latest l LEFT JOIN target t ON l.k = t.k AND l.day = t.day WHERE t.k IS NULL OR l.ums_id_ > t.ums_id_""")
def snk_15(spark, sf):
    out = to_hashes(days(spark, sf), DAY_KEYS, "t", 60, target(spark, sf))
    return out.select("key", F.col("fields")["value1"].alias("kind"),
                      F.col("fields")["ums_id_"].alias("id"), "ttl")


@query("snk_16_column_store_upsert", _UPSERTS)
def snk_16(spark, sf):
    return plan_upsert(days(spark, sf), target(spark, sf), DAY_KEYS) \
        .filter(F.col("action") != SKIP).select("k", "day", "ums_id_", "action")


@query("snk_17_newer_than_stored", f"""{WT}
    SELECT l.k, l.day, l.ums_id_ FROM latest l LEFT JOIN (
      SELECT k, day, max(ums_id_) AS top FROM days WHERE ums_ts_ <= TIMESTAMP '2024-01-16 12:00:00' GROUP BY k, day) s
    ON l.k = s.k AND l.day = s.day WHERE s.top IS NULL OR l.ums_id_ > s.top""")
def snk_17(spark, sf):
    stored = days(spark, sf).filter(F.col("ums_ts_") <= F.lit("2024-01-16 12:00:00"))
    return newer_than_stored(days(spark, sf), stored, DAY_KEYS).select("k", "day", "ums_id_")


@query("snk_18_to_shards", f"""{W}
    SELECT k, count(*) AS n, count(CASE WHEN value1 = 'view' THEN 1 END) AS filled, CAST(1 AS BIGINT) AS shards FROM changes GROUP BY k""")
def snk_18(spark, sf):
    df = changes(spark, sf).withColumn("value1", F.when(F.col("value1") != "view", F.col("value1")))
    shards = to_shards(df, ["k"], 4).groupBy("k", "shard").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value1") == "").alias("filled"))
    # a key lives in one shard
    return shards.groupBy("k").agg(F.sum("n").alias("n"), F.sum("filled").alias("filled"),
                                   F.count(F.lit(1)).alias("shards"))


@query("snk_20_to_requests", """
    SELECT 'POST' AS method, 'http://h/u/' || CAST(user_id AS VARCHAR) AS url,
           'event_type=' || event_type || '&user_id=' || CAST(user_id AS VARCHAR) AS body FROM events""")
def snk_20(spark, sf):
    from .base import table
    return to_requests(table(spark, sf, "events"), "post", "http://h/u/${user_id}", "form",
                       ["event_type", "user_id"])
