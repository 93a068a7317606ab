"""Lookups, unions and pairing: JON-*, SET-*."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.lookups import (extract_paths, kv_lookup, lookup, pair_before_after,
                                 resolve_identity, restrict_to_keys, stream_join)
from ..operators.projections import sql_step
from ..operators.sets import union_lookup
from .base import SQL_CHANGES, changes, query, table

W = "WITH " + SQL_CHANGES


@query("jon_01_lookup_inner", f"""{W}
    SELECT ums_id_, k, o_orderkey, o_totalprice FROM changes JOIN orders ON k = o_custkey""")
def jon_01(spark, sf):
    return lookup(changes(spark, sf), table(spark, sf, "orders"), [("k", "o_custkey")]) \
        .select("ums_id_", "k", "o_orderkey", "o_totalprice")


@query("jon_02_lookup_left", f"""{W}
    SELECT ums_id_, k, value1, o_orderkey, o_orderstatus FROM changes
    LEFT JOIN orders ON k = o_custkey""")
def jon_02(spark, sf):
    return lookup(changes(spark, sf), table(spark, sf, "orders"), [("k", "o_custkey")], "left") \
        .select("ums_id_", "k", "value1", "o_orderkey", "o_orderstatus")


@query("jon_03_lookup_right", f"""{W}
    SELECT ums_id_, value1, c_custkey, c_name FROM changes
    RIGHT JOIN (SELECT * FROM customer WHERE c_custkey IN (SELECT k FROM changes)) c ON k = c_custkey""")
def jon_03(spark, sf):
    return lookup(changes(spark, sf), table(spark, sf, "customer"), [("k", "c_custkey")], "right",
                  columns=["c_custkey", "c_name"]) \
        .select("ums_id_", "value1", "c_custkey", "c_name")


@query("jon_04_composite_key", """
    SELECT a.l_orderkey, a.l_partkey, o_totalprice, ps.n FROM lineitem a
    JOIN orders ON a.l_orderkey = o_orderkey
    JOIN (SELECT l_suppkey AS s, l_partkey AS p, count(*) AS n FROM lineitem GROUP BY ALL) ps
      ON a.l_partkey = ps.p AND a.l_suppkey = ps.s""")
def jon_04(spark, sf):
    li = table(spark, sf, "lineitem")
    pairs = li.groupBy(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")) \
        .agg(F.count(F.lit(1)).alias("n"))
    df = lookup(li, table(spark, sf, "orders"), [("l_orderkey", "o_orderkey")],
                columns=["o_totalprice"])
    return lookup(df, pairs, [("l_partkey", "p"), ("l_suppkey", "s")], columns=["n"]) \
        .select("l_orderkey", "l_partkey", "o_totalprice", "n")


def _null_keys(spark, sf):
    """every seventh key is missing."""
    return changes(spark, sf).withColumn("k", F.when(F.col("ums_id_") % 7 != 0, F.col("k")))


_SQL_NULL = W + """, nk AS (SELECT * EXCLUDE (k), CASE WHEN ums_id_ % 7 <> 0 THEN k END AS k FROM changes)"""


@query("jon_05_null_keys_left", f"""{_SQL_NULL}
    SELECT ums_id_, k, c_name FROM nk LEFT JOIN customer ON k = c_custkey""")
def jon_05_left(spark, sf):
    return lookup(_null_keys(spark, sf), table(spark, sf, "customer"), [("k", "c_custkey")],
                  "left").select("ums_id_", "k", "c_name")


@query("jon_05_null_keys_inner", f"""{_SQL_NULL}
    SELECT ums_id_, k, c_name FROM nk JOIN customer ON k = c_custkey""")
def jon_05_inner(spark, sf):
    return lookup(_null_keys(spark, sf), table(spark, sf, "customer"), [("k", "c_custkey")]) \
        .select("ums_id_", "k", "c_name")


@query("jon_06_keyless_lookup", """
    SELECT event_id, r_name FROM events, region""")
def jon_06(spark, sf):
    return lookup(table(spark, sf, "events"), table(spark, sf, "region"), [], columns=["r_name"]) \
        .select("event_id", "r_name")


@query("jon_07_lookup_subquery", f"""{W}
    SELECT ums_id_, k1, spent, n FROM changes JOIN (
      SELECT o_custkey AS k1, round(sum(o_totalprice), 2) AS spent, count(*) AS n FROM orders GROUP BY o_custkey) o
    ON k = k1""")
def jon_07(spark, sf):
    spent = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k1")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("spent"), F.count(F.lit(1)).alias("n"))
    return lookup(changes(spark, sf), spent, [("k", "k1")], columns=["k1", "spent", "n"]) \
        .select("ums_id_", "k1", "spent", "n")


@query("jon_08_restrict_to_keys", f"""{W}
    SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT k FROM changes WHERE ums_op_ = 'd')""")
def jon_08(spark, sf):
    deleted = changes(spark, sf).filter("ums_op_ = 'd'")
    return restrict_to_keys(table(spark, sf, "orders"), deleted, [("k", "o_custkey")]) \
        .select("o_orderkey", "o_custkey")


def _kv(spark, sf):
    """F8: customers as a key-value store."""
    c = table(spark, sf, "customer")
    return c.select(
        F.concat(F.lit("c_"), F.col("c_custkey").cast("string")).alias("key"),
        F.to_json(F.struct("c_name", F.struct("c_nationkey", "c_mktsegment").alias("at")))
        .alias("value"), F.col("c_custkey").cast("string").alias("plain"), "c_name",
        "c_nationkey")


@query("jon_09_kv_lookup_fields", f"""{_SQL_NULL}
    SELECT ums_id_, c_name AS name, c_nationkey AS nation FROM nk LEFT JOIN customer ON k = c_custkey""")
def jon_09(spark, sf):
    return kv_lookup(_null_keys(spark, sf), _kv(spark, sf), "'c_' + value(k)",
                     {"name": ("c_name", "string"), "nation": ("c_nationkey", "int")}) \
        .select("ums_id_", "name", "nation")


@query("jon_10_kv_lookup_value", f"""{W}
    SELECT ums_id_, c_custkey AS stored FROM changes LEFT JOIN customer ON k = c_custkey""")
def jon_10(spark, sf):
    return kv_lookup(changes(spark, sf), _kv(spark, sf), "'c_' + value(k)",
                     {"stored": ("value", "long")}, mode="value", kv_value="plain") \
        .select("ums_id_", "stored")


@query("jon_11_kv_lookup_json", f"""{W}
    SELECT ums_id_, c_name AS name, c_mktsegment AS segment, c_nationkey AS nation
    FROM changes LEFT JOIN customer ON k = c_custkey""")
def jon_11(spark, sf):
    return kv_lookup(changes(spark, sf), _kv(spark, sf), "'c_' + value(k)", {
        "name": ("c_name", "string"), "segment": ("at.c_mktsegment", "string"),
        "nation": ("at.c_nationkey", "int")}, mode="json") \
        .select("ums_id_", "name", "segment", "nation")


@query("jon_12_column_store_lookup", f"""{W}
    SELECT ums_id_, o_orderkey FROM changes
    LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_totalprice <= 200000) o ON k = o_custkey""")
def jon_12(spark, sf):
    return lookup(changes(spark, sf), table(spark, sf, "orders"), [("k", "o_custkey")], "left",
                  columns=["o_orderkey"],
                  where=[("o_orderstatus", "=", "F"), ("o_totalprice", "<=", 200000)]) \
        .select("ums_id_", "o_orderkey")


#: of one log joined to itself: rows of a key at most so many seconds apart
NEAR_SECONDS = 172_800
NEAR_SQL = f"""{W} SELECT l.ums_id_, r.ums_id_ AS other_id FROM changes l JOIN changes r ON l.k = r.k
      AND r.ums_ts_ >= l.ums_ts_ - INTERVAL {NEAR_SECONDS} SECOND
      AND r.ums_ts_ <= l.ums_ts_ + INTERVAL {NEAR_SECONDS} SECOND"""


@query("jon_14_stream_join_batch", NEAR_SQL)
def jon_14(spark, sf):
    c = changes(spark, sf)
    return stream_join(c, c, [("k", "k")], NEAR_SECONDS, columns={"ums_id_": "other_id"}) \
        .select("ums_id_", "other_id")


@query("jon_14_stream_join_hot_keys", NEAR_SQL.replace(" JOIN ", " LEFT JOIN "))
def jon_14_hot(spark, sf):
    c = changes(spark, sf)
    return stream_join(c, c, [("k", "k")], NEAR_SECONDS, "left", columns={"ums_id_": "other_id"},
                       hot_rows=3).select("ums_id_", "other_id")


@query("jon_15_multi_stream_join", """
    SELECT event_id, c_name, o.n FROM events JOIN customer ON user_id = c_custkey
    LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON user_id = o_custkey""")
def jon_15(spark, sf):
    return sql_step(table(spark, sf, "events"), """
        SELECT event_id, c_name, o.n FROM events JOIN customer ON user_id = c_custkey
        LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o
          ON user_id = o_custkey""", "events",
        {"customer": table(spark, sf, "customer"), "orders": table(spark, sf, "orders")})


@query("jon_16_extract_paths", """
    SELECT event_id, c_name AS name, CAST(c_nationkey AS INTEGER) AS nation,
           CASE WHEN c_custkey IS NOT NULL THEN c_mktsegment END AS second
    FROM events LEFT JOIN customer ON user_id = c_custkey""")
def jon_16(spark, sf):
    replies = table(spark, sf, "customer").select("c_custkey", F.to_json(F.struct(
        F.struct(F.col("c_name").alias("name"), F.array(
            F.struct(F.lit("x").alias("v")), F.struct(F.col("c_mktsegment").alias("v")))
            .alias("list")).alias("data"), F.col("c_nationkey").alias("code"))).alias("reply"))
    return extract_paths(table(spark, sf, "events"), "reply", {
        "name": ("data.name", "string"), "nation": ("code", "int"),
        "second": ("data.list[1].v", "string")}, replies, [("user_id", "c_custkey")]) \
        .select("event_id", "name", "nation", "second")


@query("jon_17_pair_before_after", f"""{W}
    SELECT ums_id_, ums_op_, k, value2,
           CASE WHEN ums_op_ = 'u' THEN k END AS ums_b_k,
           CASE WHEN ums_op_ = 'u' THEN value2 - 1 END AS ums_b_value2
    FROM changes WHERE ums_op_ <> 'u' OR value1 <> 'view'""")
def jon_17(spark, sf):
    # updates carry a before-image, except those of views
    c = changes(spark, sf).select("ums_id_", "ums_ts_", "ums_op_", "k", "value1", "value2")
    images = c.filter("ums_op_ = 'u' AND value1 <> 'view'") \
        .withColumns({"ums_op_": F.lit("b"), "value2": F.col("value2") - 1})
    return pair_before_after(c.unionByName(images)) \
        .select("ums_id_", "ums_op_", "k", "value2", "ums_b_k", "ums_b_value2")


@query("jon_18_resolve_identity", """
    WITH p AS (SELECT event_id, CASE WHEN event_type <> 'view' THEN user_id END AS card,
                 CASE WHEN event_type NOT IN ('view', 'error') OR user_id % 2 = 0 THEN event_type END AS phone,
                 user_id FROM events),
    q AS (SELECT *, CASE WHEN card IS NOT NULL THEN 0 WHEN phone IS NOT NULL THEN 1 END AS tier FROM p),
    r0 AS (SELECT c_custkey, max(c_custkey * 10) AS v FROM customer GROUP BY c_custkey),
    r1 AS (SELECT 'view' AS phone, max(c_custkey * 10) AS v FROM customer),
    f AS (SELECT q.*, COALESCE(r0.v, r1.v) AS v FROM q
          LEFT JOIN r0 ON tier = 0 AND card = c_custkey
          LEFT JOIN r1 ON tier = 1 AND q.phone = r1.phone),
    d AS (SELECT *, row_number() OVER (PARTITION BY tier, CASE tier WHEN 0 THEN CAST(card AS VARCHAR) WHEN 1 THEN phone
             ELSE CAST(event_id AS VARCHAR) END ORDER BY event_id) AS rn FROM f)
    SELECT event_id, COALESCE(v + 1, event_id) AS ums_id_, v IS NOT NULL AS known,
           CASE WHEN v IS NOT NULL THEN 'id-' || CAST(v / 10 AS BIGINT) END AS known_id
    FROM d WHERE rn = 1""")
def jon_18(spark, sf):
    kind = F.col("event_type")
    rows = table(spark, sf, "events").select(
        "event_id", F.col("event_id").alias("ums_id_"),
        F.when(kind != "view", F.col("user_id")).alias("card"),
        F.when(~kind.isin("view", "error") | (F.col("user_id") % 2 == 0), kind).alias("phone"))
    registry = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("card_no"), F.lit("view").alias("phone_no"),
        (F.col("c_custkey") * 10).alias("ums_id_"),
        F.concat(F.lit("id-"), F.col("c_custkey").cast("string")).alias("person"))
    out = resolve_identity(rows, registry, [[("card", "card_no")], [("phone", "phone_no")]],
                           "person", ["event_id"])
    known = F.col("person").startswith("id-")
    return out.select("event_id", "ums_id_", known.alias("known"),
                      F.when(known, F.col("person")).alias("known_id"))


@query("set_01_union_lookup", f"""{W}
    SELECT ums_id_, k, ums_op_, value1, value2 FROM changes
    UNION ALL SELECT 0, o_custkey, 'i', NULL, 0 FROM orders WHERE o_custkey IN (SELECT k FROM changes)""")
def set_01(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "k")
    return union_lookup(changes(spark, sf), orders, [("k", "k")]) \
        .select("ums_id_", "k", "ums_op_", "value1", "value2")


@query("set_02_union_constants", f"""{W}
    SELECT ums_id_, k, value1, value2 FROM changes
    UNION ALL SELECT NULL, o_custkey, 'order', o_totalprice FROM orders WHERE o_custkey IN (SELECT k FROM changes)""")
def set_02(spark, sf):
    orders = table(spark, sf, "orders").withColumnsRenamed(
        {"o_custkey": "k", "o_totalprice": "value2"})
    return union_lookup(changes(spark, sf), orders, [("k", "k")], constants={"value1": "order"},
                        missing="null").select("ums_id_", "k", "value1", "value2")


@query("set_03_sql_union", """
    SELECT user_id AS who FROM events UNION SELECT o_custkey FROM orders""")
def set_03(spark, sf):
    return sql_step(table(spark, sf, "events"), """
        SELECT user_id AS who FROM events UNION SELECT o_custkey FROM orders""", "events", {"orders": table(spark, sf, "orders")})
