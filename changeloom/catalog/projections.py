"""Projection, rules and predicates: PRJ-*, FLT-*."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.conditions import (compile_condition, filter_events, filter_time, kinds_of,
                                    pattern_condition)
from ..operators.lookups import lookup
from ..operators.projections import project_job, project_output, sql_step, with_sys_columns
from ..operators.query import query as table_query
from ..operators.rules import (Cast, Exclude, Expression, Include, Where, apply_schema_rules,
                               ensure_columns, tag_events)
from ..model import FlowSpec, Sink
from ..plans.flow import flow_rows
from ..plans.steps import CustomStep, LookupStep, SqlStep, run_steps
from .base import SQL_CHANGES, changes, query, table

W = "WITH " + SQL_CHANGES


@query("prj_01_sql_step", f"""{W}
    SELECT value1, date_part('day', ums_ts_) AS day, count(*) AS n, round(sum(value2), 2) AS total
    FROM changes WHERE ums_op_ <> 'd' GROUP BY value1, date_part('day', ums_ts_)""")
def prj_01(spark, sf):
    return sql_step(changes(spark, sf), """
        SELECT value1, CAST(date_part('day', ums_ts_) AS BIGINT) AS day, count(*) AS n, round(sum(value2), 2) AS total
        FROM events WHERE ums_op_ <> 'd' GROUP BY value1, date_part('day', ums_ts_)""", "events")


@query("prj_01_grouping_sets", """
    SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty
    FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def prj_01_cube(spark, sf):
    return sql_step(table(spark, sf, "lineitem"), """
        SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty
        FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""", "lineitem")


@query("prj_02_ordered_steps", f"""{W},
    a AS (SELECT *, upper(value1) AS kind FROM changes WHERE value2 > 10),
    b AS (SELECT a.*, c_name, c_nationkey FROM a LEFT JOIN customer ON k = c_custkey)
    SELECT kind, c_nationkey, count(*) AS n, count(c_name) AS named FROM b GROUP BY kind, c_nationkey""")
def prj_02(spark, sf):
    steps = [
        SqlStep("SELECT *, upper(value1) AS kind FROM events WHERE value2 > 10"),
        LookupStep(lambda s: table(s, sf, "customer"), [("k", "c_custkey")], "left",
                   columns=["c_name", "c_nationkey"]),
        CustomStep(lambda df: df.groupBy("kind", "c_nationkey").agg(
            F.count(F.lit(1)).alias("n"), F.count("c_name").alias("named"))),
    ]
    return run_steps(changes(spark, sf), steps, "events")


@query("prj_03_system_columns", f"""{W}
    SELECT ums_ts_, ums_id_, ums_op_, ums_uid_, k, value1 FROM changes""")
def prj_03(spark, sf):
    df = changes(spark, sf)
    return df.select(*with_sys_columns(["k", "value1"], validity=True))


@query("prj_03_sql_steps_carry", f"""{W}
    SELECT ums_ts_, ums_id_, ums_op_, upper(value1) AS kind, k + 1 AS kk FROM changes WHERE value2 > 10
    UNION ALL SELECT ums_ts_, ums_id_, ums_op_, value1, k FROM changes WHERE value2 <= 10""")
def prj_03_steps(spark, sf):
    flow = FlowSpec("kafka.k01.db.events.*.*.*", [
        SqlStep("SELECT k, value1, value2 FROM events"),
        SqlStep("SELECT upper(value1) AS kind, k + 1 AS kk FROM events WHERE value2 > 10 "
                "UNION ALL SELECT value1, k FROM events WHERE value2 <= 10")],
        Sink(print, mutation="iud"))
    return flow_rows(flow, changes(spark, sf))


@query("prj_04_project_output", f"""{W}
    SELECT k AS user_key, value1, ums_ts_, ums_id_, ums_op_ FROM changes""")
def prj_04(spark, sf):
    return project_output(changes(spark, sf), "K:user_key,value1", system=True)


@query("prj_05_project_job", f"""{W}
    SELECT value1, k, ums_id_, ums_ts_, ums_uid_, ums_op_ FROM changes""")
def prj_05(spark, sf):
    return project_job(changes(spark, sf), "value1, k, ums_id_")


@query("prj_06_rule_include", "SELECT o_orderkey, o_orderstatus FROM orders")
def prj_06(spark, sf):
    return apply_schema_rules(table(spark, sf, "orders"),
                              [Include(["o_orderkey", "o_orderstatus"])])


@query("prj_07_rule_exclude", """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders""")
def prj_07(spark, sf):
    return apply_schema_rules(table(spark, sf, "orders"),
                              [Exclude(["O_ORDERDATE", "o_orderpriority"])])


@query("prj_08_rule_cast", """
    SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS cust_text, CAST(floor(o_totalprice) AS BIGINT) AS whole FROM orders""")
def prj_08(spark, sf):
    return apply_schema_rules(table(spark, sf, "orders"), [
        Include(["o_orderkey"]), Cast("o_custkey", "string", "cust_text"),
        Cast("o_totalprice", "bigint", "whole")])


@query("prj_09_rule_expression", """
    SELECT o_orderkey, concat(substr(o_orderpriority, 1, 1), '/', o_orderstatus) AS code FROM orders""")
def prj_09(spark, sf):
    return apply_schema_rules(table(spark, sf, "orders"), [
        Include(["o_orderkey"]),
        Expression("concat(substr(o_orderpriority, 1, 1), '/', o_orderstatus)", "code")])


def _single(field, function, *params):
    return {"operator": "single",
            "filter": {"field": field, "function": function, "params": list(params)}}


_TREE = {"operator": "or", "filter": [
    {"operator": "and", "filter": [_single("event_type", "equal", "click", "view", ""),
                                   _single("value", "greater", 20)]},
    _single("user_id", "less", 10)]}
_TREE_SQL = "((event_type IN ('click', 'view') AND value > 20) OR user_id < 10)"


@query("prj_10_rule_filter", f"SELECT event_id, value FROM events WHERE {_TREE_SQL}")
def prj_10(spark, sf):
    return apply_schema_rules(table(spark, sf, "events"),
                              [Include(["event_id", "value"]), Where(_TREE), Include(["value"])])


@query("prj_11_tag_events", f"""
    SELECT event_id,
           CASE WHEN {_TREE_SQL} THEN 'hot' WHEN event_type = 'error' THEN 'bad' ELSE 'unknown' END AS tag,
           CASE WHEN event_type = 'error' THEN 'ops' ELSE 'unknown' END AS team FROM events""")
def prj_11(spark, sf):
    return tag_events(table(spark, sf, "events"), [
        (_TREE, {"tag": "hot"}),
        (_single("event_type", "contain", "error"), {"tag": "bad", "team": "ops"}),
    ]).select("event_id", "tag", "team")


@query("prj_12_ensure_columns", f"""{W}
    SELECT ums_id_, k, CAST(NULL AS VARCHAR) AS extra FROM changes""")
def prj_12(spark, sf):
    df = ensure_columns(changes(spark, sf), ["k", "extra", "ums_active_"])
    assert "ums_active_" not in df.columns
    return df.select("ums_id_", "k", "extra")


@query("prj_13_select_arithmetic", """
    SELECT l_returnflag, round(sum(l_extendedprice) / 1000, 2) AS thousands,
           round(-avg(l_discount) * 100 + 1, 4) AS shifted, count(*) % 7 AS rest
    FROM lineitem GROUP BY l_returnflag""")
def prj_13(spark, sf):
    return table_query(table(spark, sf, "lineitem"), group_by=["l_returnflag"], aggs={
        "thousands": "round(sum(l_extendedprice) / 1000, 2)",
        "shifted": "round(-avg(l_discount) * 100 + 1, 4)", "rest": "count(*) % 7"})


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("big", F.col("value") > 50)


def _where(name, tree, sql):
    @query(name, f"SELECT event_id FROM (SELECT *, value > 50 AS big FROM events) e WHERE {sql}")
    def run(spark, sf, tree=tree):
        df = _events(spark, sf)
        return df.filter(compile_condition(tree, kinds_of(df))).select("event_id")


_where("flt_01_condition_tree", _TREE, _TREE_SQL)
_where("flt_02_not_equal", _single("event_type", "notEqual", "click", "view"),
       "event_type NOT IN ('click', 'view')")
_where("flt_02_equal_number", _single("user_id", "equal", 3, 5, 7), "user_id IN (3, 5, 7)")
_where("flt_03_contain_first", _single("event_type", "contain", "click", "view"),
       "event_type = 'click'")
_where("flt_03_not_contain", _single("user_id", "notContain", 4, 5), "user_id <> 4")
_where("flt_04_is_set", _single("value", "isSet"), "value IS NOT NULL")
_where("flt_05_not_empty", {"operator": "and", "filter": [
    _single("props", "notEmpty"), _single("value", "notEmpty")]},
    "props <> '' AND value IS NOT NULL")
_where("flt_07_compare", {"operator": "and", "filter": [
    _single("value", "gteq", 5), _single("value", "lteq", 60), _single("user_id", "less", 100),
    _single("ts", "greater", "2024-01-03 00:00:00")]},
    "value >= 5 AND value <= 60 AND user_id < 100 AND ts > TIMESTAMP '2024-01-03 00:00:00'")
_where("flt_08_between_time", _single("ts", "between", "2024-01-03 10:30", "2024-01-09 23:59"),
       "ts BETWEEN TIMESTAMP '2024-01-03 10:30:00' AND TIMESTAMP '2024-01-09 23:59:00'")
_where("flt_09_true", _single("big", "true"), "big")
_where("flt_09_false", _single("big", "false"), "NOT big")


@query("flt_04_not_set", """
    SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def flt_04(spark, sf):
    df = lookup(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"),
                [("doc_id", "doc_id")], "left", columns=["quality"])
    return df.filter(compile_condition(_single("quality", "notSet"), kinds_of(df))) \
        .select("doc_id")


@query("flt_10_pattern_predicates", """
    SELECT event_id FROM events
    WHERE (event_type LIKE '%c%' AND (value >= 12.5 OR user_id <= 20))
       OR (event_type LIKE '%or' AND user_id <> 3)""")
def flt_10(spark, sf):
    def one(field, test, value):
        return {"operator": "single",
                "logic": {"field_name": field, "compare_type": test, "value": value}}

    def both(op, *parts):
        return {"operator": op, "logic": list(parts)}

    tree = both("or", both("and", one("event_type", "like", "c"), both(
        "or", one("value", "gteq", "12.5"), one("user_id", "lteq", "20"))), both(
        "and", one("event_type", "endwith", "or"), one("user_id", "neq", "3")))
    df = table(spark, sf, "events")
    return df.filter(pattern_condition(tree, df.schema)).select("event_id")


@query("flt_11_lookup_conditions", """
    SELECT event_id, o_orderkey, o_totalprice FROM events JOIN orders ON user_id = o_custkey
    WHERE o_totalprice > 100000 AND o_orderstatus IN ('F', 'O') AND o_orderdate IS NOT NULL""")
def flt_11(spark, sf):
    return lookup(table(spark, sf, "events"), table(spark, sf, "orders"),
                  [("user_id", "o_custkey")], "inner",
                  where=[("o_totalprice", ">", 100000), ("o_orderstatus", "in", ["F", "O"]),
                         ("o_orderdate", "is not null")]) \
        .select("event_id", "o_orderkey", "o_totalprice")


_FLT_12 = """NOT (p_size < 10 OR p_size >= 45) AND p_brand LIKE 'Brand#%' AND p_type IN ('ECONOMY', 'STANDARD', 'PROMO')
    AND p_retailprice BETWEEN 900 AND 1500 AND p_name IS NOT NULL AND p_partkey <> p_size"""


@query("flt_12_table_predicates", f"SELECT p_partkey, p_size FROM part WHERE {_FLT_12}")
def flt_12(spark, sf):
    return table_query(table(spark, sf, "part"), ["p_partkey", "p_size"], _FLT_12)


@query("flt_13_filter_events", """
    SELECT event_id FROM (SELECT *, user_id % 3 AS project,
        CASE event_type WHEN 'click' THEN 'track' WHEN 'signup' THEN 'track_signup' ELSE 'profile_set' END AS type FROM events) e
    WHERE project = 1 AND type IN ('track', 'track_signup')""")
def flt_13(spark, sf):
    df = table(spark, sf, "events").withColumns({
        "project": F.col("user_id") % 3,
        "type": F.when(F.col("event_type") == "click", "track")
        .when(F.col("event_type") == "signup", "track_signup").otherwise("profile_set")})
    return filter_events(df, 1, "project", "type").select("event_id")


@query("flt_14_filter_time", """
    SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 06:30:00'""")
def flt_14(spark, sf):
    return filter_time(table(spark, sf, "events"), "2024-01-10", "2024-01-12 06:30:00", "ts") \
        .select("event_id")
