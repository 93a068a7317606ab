"""Sources and decoding: SRC-*."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import normalize_ts
from ..session import shared_dir
from ..sources.archive import read_archive, write_archive
from ..sources.ext_json import JsonField, operation_field, read_ext_json
from ..sources.messages import (apply_ums_schema, classify_messages, filter_protocol,
                                match_namespace, read_ums, rename_keys)
from ..sources.tables import parquet_table
from .base import FIELDS, NAMESPACE, messages, query, table

_TYPED_SQL = """SELECT event_id AS ums_id_, date_trunc('milliseconds', ts) AS ums_ts_, 'i' AS ums_op_,
                       user_id AS k, event_type AS value1 FROM events"""


@query("src_01_read_ums", """
    SELECT 'data_increment_data' AS protocol,
           'kafka.k01.db.events.1.0.' || CAST(user_id % 4 AS VARCHAR) AS namespace, 5 AS n_fields,
           CAST(event_id AS VARCHAR) AS cell0, event_type AS cell4 FROM events""")
def src_01(spark, sf):
    return read_ums(messages(spark, sf)).select(
        "protocol", "namespace", F.size("fields").alias("n_fields"),
        F.col("tuple")[0].alias("cell0"), F.col("tuple")[4].alias("cell4"))


@query("src_02_apply_ums_schema", _TYPED_SQL)
def src_02(spark, sf):
    return apply_ums_schema(read_ums(messages(spark, sf)), FIELDS)


@query("src_02_bad_rows", """
    SELECT event_id AS ums_id_ FROM events WHERE event_type = 'error'""")
def src_02_bad(spark, sf):
    # the event type is declared a number where it is not one
    m = messages(spark, sf).withColumn("value", F.when(
        F.contains("value", F.lit('"error"')), F.col("value")).otherwise(
        F.regexp_replace("value", '"(click|view|signup|purchase)"]', '"17"]')))
    fields = [*FIELDS[:4], type(FIELDS[0])("value1", "int")]
    return apply_ums_schema(read_ums(m), fields, bad="only").select("ums_id_")


def _nested(spark, sf):
    """nested objects, arrays and delimited text out of events."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.to_json(F.struct(
        F.col("event_id").alias("id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("time"),
        F.when(F.col("event_type") == "signup", "ins").when(F.col("event_type") == "error", "del")
        .when(F.col("event_type") == "view", "odd").otherwise("upd").alias("op"),
        F.when(F.col("event_type") != "error", F.struct(
            F.col("user_id").alias("user"),
            F.struct(F.col("event_type").alias("type"), F.col("value").alias("value"))
            .alias("detail"))).alias("body"),
        F.when(k > 50, F.array(k, k + 1)).when(k > 25, F.array().cast("array<int>"))
        .alias("nums"),
        F.transform(F.sequence(F.lit(1), F.lit(1) + k % 3), lambda i: F.struct(
            i.alias("no"), (i * k).alias("qty"))).alias("lines"),
        F.concat_ws("|", "event_type", F.col("user_id").cast("string")).alias("pair"))).alias("value"))


_ID = JsonField("id", "long")
_SQL_K = "CAST(json_extract(props, '$.k') AS INTEGER)"


@query("src_03_ext_json_objects", """
    SELECT event_id AS id, CASE WHEN event_type <> 'error' THEN user_id END AS "user",
           CASE WHEN event_type <> 'error' THEN event_type END AS type,
           CASE WHEN event_type <> 'error' THEN value END AS value FROM events""")
def src_03(spark, sf):
    return read_ext_json(_nested(spark, sf), "value", [
        _ID, JsonField("body", "jsonobject", (
            JsonField("user", "long"),
            JsonField("detail", "jsonobject", (JsonField("type"), JsonField("value", "double")))))])


@query("src_04_ext_json_array", f"""
    SELECT event_id AS id, n.unnest AS nums FROM (
      SELECT event_id, {_SQL_K} AS k FROM events) e,
      UNNEST(CASE WHEN k > 50 THEN [k, k + 1] WHEN k > 25 THEN [] ELSE [NULL] END) n""")
def src_04(spark, sf):
    return read_ext_json(_nested(spark, sf), "value", [_ID, JsonField("nums", "intarray")])


@query("src_05_ext_json_object_array", f"""
    SELECT event_id AS id, CAST(n.unnest AS INTEGER) AS no, CAST(n.unnest * k AS INTEGER) AS qty,
           event_type || '|' || CAST(user_id AS VARCHAR) AS pair
    FROM (SELECT *, {_SQL_K} AS k FROM events) e, UNNEST(range(1, 2 + k % 3)) n""")
def src_05(spark, sf):
    return read_ext_json(_nested(spark, sf), "value", [
        _ID, JsonField("lines", "jsonarray", (JsonField("no", "int"), JsonField("qty", "int"))),
        JsonField("pair")])


@query("src_06_ext_json_tuple", """
    SELECT event_id AS id, event_type AS kind, user_id AS who FROM events""")
def src_06(spark, sf):
    return read_ext_json(_nested(spark, sf), "value", [
        _ID, JsonField("pair", "tuple", (JsonField("kind"), JsonField("who", "long")), "|")])


@query("src_07_ext_json_rename", """
    SELECT event_id AS ums_id_, date_trunc('milliseconds', ts) AS ums_ts_, event_id AS id
    FROM events""")
def src_07(spark, sf):
    return read_ext_json(_nested(spark, sf), "value", [
        JsonField("id", "long", rename="ums_id_"), JsonField("time", "long", rename="ums_ts_"),
        _ID])


_CODES = "i:ins,u:upd,d:del"


@query("src_08_ext_json_op_codes", """
    SELECT event_id AS id, CASE event_type WHEN 'signup' THEN 'i' WHEN 'error' THEN 'd' ELSE 'u' END AS ums_op_
    FROM events WHERE event_type <> 'view'""")
def src_08(spark, sf):
    return read_ext_json(_nested(spark, sf), "value", [_ID, operation_field("op", _CODES)])


@query("src_08_unmapped_codes", """
    SELECT event_id AS id FROM events WHERE event_type = 'view'""")
def src_08_bad(spark, sf):
    return read_ext_json(_nested(spark, sf), "value", [_ID, operation_field("op", _CODES)],
                         bad="only").select("id")


@query("src_09_normalize_ts", """
    SELECT event_id, date_trunc('second', ts) AS from_seconds, date_trunc('milliseconds', ts) AS from_millis,
           date_trunc('milliseconds', ts) AS from_micros, date_trunc('milliseconds', ts) AS from_text
    FROM events""")
def src_09(spark, sf):
    e = table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.select("event_id", normalize_ts(F.unix_seconds("t")).alias("from_seconds"),
                    normalize_ts(F.unix_millis("t")).alias("from_millis"),
                    normalize_ts(F.unix_micros("t")).alias("from_micros"),
                    normalize_ts(F.date_format("t", "yyyy/MM/dd HH:mm:ss.SSSSSS"))
                    .alias("from_text"))


def _mixed_keys(spark, sf):
    """Messages whose keys are full, short, blank, unknown or missing."""
    kind = F.get_json_object("value", "$.payload[0].tuple[4]")
    return messages(spark, sf).select(
        F.when(kind == "view", F.lit(None)).when(kind == "click", F.lit("  "))
        .when(kind == "error", F.lit("data_initial_data.a.b.c"))
        .when(kind == "signup", F.concat(F.lit("what."), F.col("key")))
        .otherwise(F.concat(F.upper("key"), F.lit(".0.filler"))).alias("key"),
        "value", kind.alias("kind"), F.get_json_object("value", "$.payload[0].tuple[0]")
        .cast("long").alias("event_id"))


@query("src_10_classify_messages", """
    SELECT event_id,
           CASE event_type WHEN 'view' THEN 'data_increment_heartbeat' WHEN 'click' THEN 'data_increment_data'
             WHEN 'error' THEN 'data_initial_data' WHEN 'signup' THEN 'data_increment_heartbeat'
             ELSE 'data_increment_data' END AS protocol,
           CASE WHEN event_type IN ('view', 'error', 'signup') THEN ''
             ELSE 'kafka.k01.db.events.1.0.' || CAST(user_id % 4 AS VARCHAR) END AS namespace
    FROM events""")
def src_10(spark, sf):
    return classify_messages(_mixed_keys(spark, sf)).select("event_id", "protocol", "namespace")


@query("src_11_rename_keys", """
    SELECT event_id, CASE event_type WHEN 'click' THEN 'renamed.topic'
        WHEN 'view' THEN CASE WHEN user_id % 4 = 0 THEN 'renamed.key' ELSE 'data_increment_data.kafka.k01.db.events.1.0.' || CAST(user_id % 4 AS VARCHAR) END
        ELSE 'data_increment_data.kafka.k01.db.events.1.0.' || CAST(user_id % 4 AS VARCHAR) END AS key
    FROM events""")
def src_11(spark, sf):
    m = messages(spark, sf).withColumns({
        "topic": F.get_json_object("value", "$.payload[0].tuple[4]"),
        "event_id": F.get_json_object("value", "$.payload[0].tuple[0]").cast("long")})
    return rename_keys(m, by_topic={"click": "renamed.topic"}, by_topic_key={
        ("view", f"data_increment_data.{NAMESPACE}0"): "renamed.key",
        ("click", f"data_increment_data.{NAMESPACE}0"): "never"}).select("event_id", "key")


@query("src_12_match_namespace", """
    SELECT event_id, TRUE AS core, user_id % 4 = 1 AS stream, user_id % 4 = 2 AS archive FROM events""")
def src_12(spark, sf):
    m = classify_messages(messages(spark, sf))
    return m.select(
        F.get_json_object("value", "$.payload[0].tuple[0]").cast("long").alias("event_id"),
        match_namespace("namespace", "kafka.k01.db.events.9.9.9").alias("core"),
        match_namespace("namespace", f"{NAMESPACE}1", "stream").alias("stream"),
        match_namespace("namespace", "kafka.*.db.events.*.*.2", "archive").alias("archive"))


@query("src_13_filter_protocol", """
    SELECT protocol, count(*) AS n FROM (
      SELECT CASE event_type WHEN 'error' THEN 'data_initial_data' WHEN 'click' THEN 'data_increment_data'
        WHEN 'purchase' THEN 'data_increment_data' ELSE 'data_increment_heartbeat' END AS protocol
      FROM events) t WHERE protocol = 'data_increment_data' GROUP BY protocol""")
def src_13(spark, sf):
    m = filter_protocol(classify_messages(_mixed_keys(spark, sf)), initial=False, batch=False)
    return m.groupBy("protocol").agg(F.count(F.lit(1)).alias("n"))


def _written_archive(spark, sf, versions=1):
    path = shared_dir(spark, "archive")
    m = messages(spark, sf)
    if versions > 1:
        # a table version per event type, numbered so that text order would be wrong
        kind = F.get_json_object("value", "$.payload[0].tuple[4]")
        version = F.when(kind == "click", "9").when(kind == "view", "10").otherwise("2")
        m = m.withColumn("key", F.regexp_replace(
            "key", F.lit(r"\.events\.1\."), F.concat(F.lit(".events."), version, F.lit("."))))
    write_archive(m, path)
    return path


@query("src_15_read_archive_pruned", f"""
    SELECT * FROM ({_TYPED_SQL}) t
    WHERE ums_ts_ >= TIMESTAMP '2024-01-05 00:00:00' AND ums_ts_ <= TIMESTAMP '2024-01-20 12:00:00'""")
def src_15(spark, sf):
    return read_archive(spark, _written_archive(spark, sf), "kafka.k01.db.events.1.*.*", FIELDS,
                        "2024-01-05 00:00:00", "2024-01-20 12:00:00")


@query("src_16_archive_latest_version", f"""
    SELECT * FROM ({_TYPED_SQL}) t WHERE value1 = 'view'""")
def src_16(spark, sf):
    return read_archive(spark, _written_archive(spark, sf, 3), "kafka.k01.db.events.*.*.*", FIELDS)


@query("src_18_parquet_table", """
    SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey""")
def src_18(spark, sf):
    parquet_table(spark, "lookup_nation", f"{sf}/nation.parquet")
    parquet_table(spark, "lookup_region", f"{sf}/region.parquet")
    return spark.sql("SELECT n_name, r_name FROM lookup_nation "
                     "JOIN lookup_region ON n_regionkey = r_regionkey")
