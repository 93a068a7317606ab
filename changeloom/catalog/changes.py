"""Change data and windows: CDC-*, WIN-*, SRT-03, and the flagship flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import ts_not_before
from ..operators.blocks import over_range, over_rows, running_total
from ..operators.changes import (apply_changes, apply_split, dedup, increment_by_ts, merge_latest,
                                 partition_by_keys, plan_split_upsert, plan_upsert, snapshot,
                                 with_active)
from ..operators.lookups import lookup
from ..operators.projections import project_output, sql_step
from ..operators.query import top_k
from ..sources.messages import apply_ums_schema, read_ums
from .base import (DAY_KEYS, FIELDS, SQL_CHANGES, SQL_TARGET, changes, days, messages,
                   query, table, target)

W = "WITH " + SQL_CHANGES
WT = "WITH " + SQL_TARGET


@query("flow_messages_to_snapshot", """
    SELECT id, ts AS ums_ts_, user_id, kind, c_name, n_name FROM (
      SELECT event_id AS id, date_trunc('milliseconds', ts) AS ts, user_id, upper(event_type) AS kind, c_name, n_name,
             row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn
      FROM events LEFT JOIN customer ON user_id = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
      ) t WHERE rn = 1""")
def flow_messages_to_snapshot(spark, sf):
    rows = apply_ums_schema(read_ums(messages(spark, sf)), FIELDS)
    rows = sql_step(rows, "SELECT *, upper(value1) AS kind FROM events", "events")
    places = lookup(table(spark, sf, "customer"), table(spark, sf, "nation"),
                    [("c_nationkey", "n_nationkey")], "left")
    # the snapshot comes first: it keeps one row per key, so the lookup joins fewer rows
    rows = snapshot(rows, ["k"])
    rows = lookup(rows, places, [("k", "c_custkey")], "left", columns=["c_name", "n_name"])
    return project_output(rows, "ums_id_:id,ums_ts_,k:user_id,kind,c_name,n_name")


@query("cdc_01_merge_latest", f"""{W}
    SELECT ums_id_, ums_op_, k, value1 FROM (
      SELECT *, row_number() OVER (PARTITION BY k ORDER BY ums_id_ DESC) AS rn FROM changes) t WHERE rn = 1""")
def cdc_01(spark, sf):
    c = changes(spark, sf)
    images = c.filter("ums_op_ = 'u'").withColumn("ums_op_", F.lit("b"))
    return merge_latest(c.unionByName(images), ["k"]) \
        .select("ums_id_", "ums_op_", "k", "value1")


@query("cdc_02_snapshot", f"""{W}
    SELECT k, ums_id_, ums_op_, value1, value2 FROM (
      SELECT *, row_number() OVER (PARTITION BY k ORDER BY ums_id_ DESC) rn FROM changes
      WHERE ums_ts_ >= TIMESTAMP '2024-01-02 00:00:00' AND ums_ts_ <= TIMESTAMP '2024-01-20 00:00:00') t
    WHERE rn = 1 AND ums_op_ <> 'd'""")
def cdc_02(spark, sf):
    return snapshot(changes(spark, sf), ["k"], "2024-01-02 00:00:00", "2024-01-20 00:00:00") \
        .select("k", "ums_id_", "ums_op_", "value1", "value2")


@query("cdc_03_increment_by_ts", f"""{W}
    SELECT k, ums_id_, value1 FROM (
      SELECT *, row_number() OVER (PARTITION BY k ORDER BY ums_id_ DESC) rn FROM changes
      WHERE ums_ts_ >= TIMESTAMP '2024-01-05 00:00:00' AND ums_ts_ <= TIMESTAMP '2024-01-06 11:59:59.999') t
    WHERE rn = 1 AND ums_op_ <> 'd'""")
def cdc_03(spark, sf):
    return increment_by_ts(changes(spark, sf), ["k"], "2024-01-05 00:00:00",
                           "2024-01-06 11:59:59").select("k", "ums_id_", "value1")


@query("cdc_04_plan_upsert", f"""{WT}
    SELECT l.k, l.day, l.ums_id_, CASE WHEN t.k IS NULL THEN 'i' WHEN l.ums_id_ > t.ums_id_ THEN 'u' ELSE 'skip' END AS action
    FROM latest l LEFT JOIN target t ON l.k = t.k AND l.day = t.day""")
def cdc_04(spark, sf):
    return plan_upsert(days(spark, sf), target(spark, sf), DAY_KEYS) \
        .select("k", "day", "ums_id_", "action")


@query("cdc_05_with_active", f"""{W}
    SELECT ums_id_, k, CASE WHEN ums_op_ = 'd' THEN 0 ELSE 1 END AS ums_active_ FROM changes""")
def cdc_05(spark, sf):
    return with_active(changes(spark, sf)).select("ums_id_", "k", "ums_active_")


_APPLIED_SQL = f"""{WT}
    SELECT l.k, l.day, l.ums_id_, l.value1, l.value2, CASE WHEN l.ums_op_ = 'd' THEN 0 ELSE 1 END AS ums_active_ FROM latest l"""


@query("cdc_06_apply_changes", _APPLIED_SQL)
def cdc_06(spark, sf):
    return apply_changes(target(spark, sf), days(spark, sf), DAY_KEYS) \
        .select("k", "day", "ums_id_", "value1", "value2", "ums_active_")


@query("cdc_06_apply_twice", _APPLIED_SQL)
def cdc_06_twice(spark, sf):
    log = days(spark, sf)
    once = apply_changes(target(spark, sf), log, DAY_KEYS)
    return apply_changes(once, log, DAY_KEYS) \
        .select("k", "day", "ums_id_", "value1", "value2", "ums_active_")


@query("cdc_07_insert_only", f"""{WT}
    SELECT k, ums_id_, ums_active_ FROM target
    UNION ALL SELECT k, ums_id_, CASE WHEN ums_op_ = 'd' THEN 0 ELSE 1 END FROM days""")
def cdc_07(spark, sf):
    return apply_changes(target(spark, sf), days(spark, sf), DAY_KEYS, mutation="i") \
        .select("k", "ums_id_", "ums_active_")


_SPLIT = WT + """, master AS (SELECT k, day, value1, value2 FROM target WHERE ums_active_ = 1),
    meta AS (SELECT k, day, ums_id_, ums_ts_, ums_active_ FROM target WHERE day >= '2024-01-08'),
    plan AS (SELECT l.*, CASE WHEN v.k IS NOT NULL AND l.ums_id_ <= v.ums_id_ THEN 'skip' ELSE
        (CASE WHEN l.ums_op_ = 'd' THEN CASE WHEN m.k IS NULL THEN 'none' ELSE 'd' END
              ELSE CASE WHEN m.k IS NULL THEN 'i' ELSE 'u' END END)
        || '_' || CASE WHEN v.k IS NULL THEN 'i' ELSE 'u' END END AS action
      FROM latest l LEFT JOIN master m ON l.k = m.k AND l.day = m.day
      LEFT JOIN meta v ON l.k = v.k AND l.day = v.day)"""


def _split_tables(spark, sf):
    t = target(spark, sf)
    return (t.filter("ums_active_ = 1").select("k", "day", "value1", "value2"),
            t.filter("day >= '2024-01-08'").select("k", "day", "ums_id_", "ums_ts_", "ums_active_"))


@query("cdc_08_plan_split_upsert", f"{_SPLIT} SELECT k, day, ums_id_, action FROM plan")
def cdc_08(spark, sf):
    master, meta = _split_tables(spark, sf)
    return plan_split_upsert(days(spark, sf), master, meta, DAY_KEYS) \
        .select("k", "day", "ums_id_", "action")


@query("cdc_08_split_master", f"""{_SPLIT}
    SELECT k, day, value1, value2 FROM master m
      WHERE NOT EXISTS (SELECT 1 FROM plan p WHERE p.k = m.k AND p.day = m.day AND action <> 'skip')
    UNION ALL SELECT k, day, value1, value2 FROM plan WHERE action <> 'skip' AND ums_op_ <> 'd'""")
def cdc_08_master(spark, sf):
    return apply_split(days(spark, sf), *_split_tables(spark, sf), DAY_KEYS)[0]


@query("cdc_08_split_meta", f"""{_SPLIT}
    SELECT k, day, ums_id_, ums_ts_, ums_active_ FROM meta m
      WHERE NOT EXISTS (SELECT 1 FROM plan p WHERE p.k = m.k AND p.day = m.day AND action <> 'skip')
    UNION ALL SELECT k, day, ums_id_, ums_ts_, CASE WHEN ums_op_ = 'd' THEN 0 ELSE 1 END
      FROM plan WHERE action <> 'skip'""")
def cdc_08_meta(spark, sf):
    return apply_split(days(spark, sf), *_split_tables(spark, sf), DAY_KEYS)[1]


@query("cdc_09_partition_by_keys", f"""{W}
    SELECT k, ums_id_, ums_op_ FROM (
      SELECT *, row_number() OVER (PARTITION BY k ORDER BY ums_id_ DESC) AS rn FROM changes) t WHERE rn = 1""")
def cdc_09(spark, sf):
    latest = merge_latest(changes(spark, sf), ["k"])
    return partition_by_keys(latest, ["k"]).select("k", "ums_id_", "ums_op_")


@query("cdc_10_dedup", """
    SELECT event_id, user_id, event_type FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) t WHERE rn = 1""")
def cdc_10(spark, sf):
    return dedup(table(spark, sf, "events"), ["user_id", "event_type"], ["event_id"]) \
        .select("event_id", "user_id", "event_type")


@query("cdc_11_ts_not_before", """
    SELECT event_id, CASE WHEN b = '' THEN TRUE WHEN length(a) < length(b) THEN a > substr(b, 1, length(a))
        ELSE substr(a, 1, length(b)) >= b END AS ok
    FROM (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN strftime(ts, '%Y%m%d%H') ELSE strftime(ts, '%Y%m%d%H%M%S') END AS a,
            CASE event_type WHEN 'view' THEN '' WHEN 'click' THEN '20240115' ELSE '2024011512' || '3000' END AS b FROM events) t""")
def cdc_11(spark, sf):
    e = table(spark, sf, "events")
    a = F.when(F.col("user_id") % 2 == 0, F.date_format("ts", "yyyyMMddHH")) \
        .otherwise(F.date_format("ts", "yyyyMMddHHmmss"))
    b = F.when(F.col("event_type") == "view", "").when(F.col("event_type") == "click", "20240115") \
        .otherwise("20240115123000")
    return e.select("event_id", a.alias("a"), b.alias("b")) \
        .select("event_id", ts_not_before("a", "b").alias("ok"))


@query("win_01_ranking", """
    SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderkey) AS rn
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderstatus)""")
def win_01(spark, sf):
    return sql_step(table(spark, sf, "orders"), """
        SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS r,
               dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS d,
               row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderkey) AS rn
        FROM orders""", "orders")


_OVER = """SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 2) AS total,
           first_value(value) OVER w AS head, last_value(value) OVER w AS tail, max(value) OVER w AS top
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"""


def _over(spark, sf, **kw):
    return over_rows(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], 4, {
        "n": F.count(F.lit(1)), "total": F.sum("value"), "head": F.first("value"),
        "tail": F.last("value"), "top": F.max("value")}, **kw) \
        .select("event_id", "n", F.round("total", 2).alias("total"), "head", "tail", "top")


@query("win_02_over_rows", _OVER)
def win_02(spark, sf):
    return _over(spark, sf)


@query("win_02_over_rows_split_keys", _OVER)
def win_02_split(spark, sf):
    # every user counts as long here, so all go through the block split
    return _over(spark, sf, block_rows=16)


@query("win_02_running_total_split_keys", """
    SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS total FROM events""")
def win_02_total(spark, sf):
    return running_total(table(spark, sf, "events"), ["event_type"], ["ts", "event_id"], "value",
                         "total", block_rows=100) \
        .select("event_id", F.round("total", 2).alias("total"))


@query("win_02_over_range_split_keys", """
    SELECT event_id, count(*) OVER w AS n, max(value) OVER w AS top FROM events
    WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 7200 SECOND PRECEDING AND CURRENT ROW)""")
def win_02_range(spark, sf):
    return over_range(table(spark, sf, "events"), ["event_type"], "ts", 7200,
                      {"n": F.count(F.lit(1)), "top": F.max("value")}, block_rows=200) \
        .select("event_id", "n", "top")


@query("srt_03_top_k", """
    SELECT o_custkey, o_orderkey, o_totalprice FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t
    WHERE rn <= 3""")
def srt_03(spark, sf):
    return top_k(table(spark, sf, "orders"), ["o_custkey"],
                 ["o_totalprice desc", "o_orderkey"], 3) \
        .select("o_custkey", "o_orderkey", "o_totalprice")
