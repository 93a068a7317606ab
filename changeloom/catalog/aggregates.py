"""Aggregation, sorting, metrics and user aggregates: AGG-*, SRT-*, UDX-*, STM-14, 17, 18."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.aggregates import adjacent_sub, first_value, last_value, weighted_avg
from ..operators.metrics import (backfill, error_batches, error_records, flow_errors, flow_stats,
                                 heartbeat_stats, latest_metric, ts_profile)
from ..operators.query import query as table_query
from ..plans.registry import Udaf, aggregate_udaf, register_udaf, register_udf
from ..sources.messages import classify_messages
from .base import SQL_CHANGES, changes, messages, query, table

W = "WITH " + SQL_CHANGES


@query("agg_01_grouped", """
    SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 4) AS avg_qty, round(sum(l_extendedprice), 2) AS total,
           min(l_discount) AS low, max(l_tax) AS high, count(*) AS n, count(1) AS n1, count(l_shipdate) AS dated
    FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def agg_01(spark, sf):
    return table_query(table(spark, sf, "lineitem"), group_by=["l_returnflag", "l_linestatus"],
                       aggs={"avg_qty": "round(avg(l_quantity), 4)",
                             "total": "round(sum(l_extendedprice), 2)", "low": "min(l_discount)",
                             "high": "max(l_tax)", "n": "count(*)", "n1": "count(1)",
                             "dated": "count(l_shipdate)"})


@query("agg_02_global", """
    SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_orderdate) AS last FROM orders""")
def agg_02(spark, sf):
    return table_query(table(spark, sf, "orders"), aggs={
        "n": "count(*)", "total": "round(sum(o_totalprice), 2)", "last": "max(o_orderdate)"})


@query("agg_03_distinct", "SELECT DISTINCT p_brand, p_type FROM part")
def agg_03(spark, sf):
    return table_query(table(spark, sf, "part"), ["p_brand", "p_type"], distinct=True)


@query("agg_04_having", """
    SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last, round(sum(o_totalprice), 2) AS total FROM orders
    GROUP BY o_custkey HAVING (count(*) >= 12 OR round(sum(o_totalprice), 2) < 500000) AND max(o_orderkey) > o_custkey""")
def agg_04(spark, sf):
    return table_query(table(spark, sf, "orders"), group_by=["o_custkey"], aggs={
        "n": "count(*)", "last": "max(o_orderkey)", "total": "round(sum(o_totalprice), 2)"},
        having="(n >= 12 OR total < 500000) AND last > o_custkey")


@query("agg_05_first_value", f"""{W}
    SELECT k, min_by(value2, ums_id_) AS head FROM changes GROUP BY k""")
def agg_05(spark, sf):
    return changes(spark, sf).groupBy("k").agg(
        first_value("value2", ["ums_ts_", "ums_id_"]).alias("head"))


@query("agg_06_last_value", f"""{W}
    SELECT k, max_by(value2, ums_id_) AS tail FROM changes GROUP BY k""")
def agg_06(spark, sf):
    return changes(spark, sf).groupBy("k").agg(
        last_value("value2", ["ums_ts_", "ums_id_"]).alias("tail"))


@query("agg_07_adjacent_sub", f"""{W},
    r AS (SELECT k, value2, row_number() OVER (PARTITION BY k ORDER BY ums_id_ DESC) AS rn,
                 lead(value2) OVER (PARTITION BY k ORDER BY ums_id_ DESC) AS prev FROM changes)
    SELECT k, round(CASE WHEN prev IS NULL THEN 0 WHEN value2 < prev THEN value2 ELSE value2 - prev END, 4) AS diff
    FROM r WHERE rn = 1""")
def agg_07(spark, sf):
    out = adjacent_sub(changes(spark, sf), ["k"], "value2", ["ums_ts_", "ums_id_"])
    return out.select("k", F.round("diff", 4).alias("diff"))


@query("agg_08_weighted_avg", """
    SELECT l_returnflag, sum(l_partkey * l_linenumber) // sum(l_linenumber) AS wavg FROM lineitem GROUP BY l_returnflag""")
def agg_08(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag") \
        .agg(weighted_avg("l_partkey", F.col("l_linenumber").cast("long")).alias("wavg"))


@query("agg_09_ts_profile", """
    SELECT 'data_increment_data' AS protocol, 'kafka.k01.db.events.1.0.' || CAST(user_id % 4 AS VARCHAR) AS namespace,
           min(ts) AS min_ts, max(ts) AS max_ts, count(*) AS n FROM events GROUP BY user_id % 4""")
def agg_09(spark, sf):
    rows = classify_messages(messages(spark, sf)).select(
        "protocol", "namespace",
        F.get_json_object("value", "$.payload[0].tuple[1]").cast("timestamp").alias("ums_ts_"))
    return ts_profile(rows)


def _stages(spark, sf):
    """a day's event times as the stage times of one batch."""
    e = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(
        F.min("ts").alias("a"), F.max("ts").alias("z"), F.count(F.lit(1)).alias("n"))
    span = (F.unix_micros(F.col("z").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp")))
    at = [F.timestamp_micros(F.unix_micros(F.col("a").cast("timestamp")) + F.floor(span * i / 5)
                             .cast("long")).alias(f"s{i}") for i in range(6)]
    return e.select("day", "n", *at)


@query("agg_10_flow_stats", """
    WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, epoch_us(min(ts)) AS a, epoch_us(max(ts)) - epoch_us(min(ts)) AS span
               FROM events GROUP BY 1),
    s AS (SELECT day, n, a // 1000 AS s0, CAST(a + floor(span * 1 / 5) AS BIGINT) // 1000 AS s1,
            CAST(a + floor(span * 2 / 5) AS BIGINT) // 1000 AS s2, CAST(a + floor(span * 3 / 5) AS BIGINT) // 1000 AS s3,
            CAST(a + floor(span * 4 / 5) AS BIGINT) // 1000 AS s4, CAST(a + floor(span * 5 / 5) AS BIGINT) // 1000 AS s5 FROM d)
    SELECT CAST(day AS VARCHAR) AS day, CAST((s2 - s0) // 1000 AS BIGINT) AS data_to_main, (s2 - s1) // 1000 AS batch_to_main,
           (s3 - s2) // 1000 AS main_to_transform, (s4 - s3) // 1000 AS transform_to_sink, (s5 - s4) // 1000 AS sink_to_done,
           (s5 - s1) // 1000 AS batch_to_done,
           CAST(CASE WHEN (s5 - s1) // 1000 = 0 THEN n * 1000000 ELSE n * 1000000 // ((s5 - s1) // 1000) END AS BIGINT) AS throughput
    FROM s""")
def agg_10(spark, sf):
    df = _stages(spark, sf).withColumn("n", F.col("n") * 1_000_000)
    out = flow_stats(df, [f"s{i}" for i in range(6)])
    return out.drop("n", *[f"s{i}" for i in range(6)]) \
        .withColumn("day", F.col("day").cast("string"))


@query("agg_11_latest_metric", f"""{W}
    SELECT k, value1, max(ums_ts_) AS ums_ts_, max_by(value2, ums_id_) AS value2 FROM changes GROUP BY k, value1""")
def agg_11(spark, sf):
    return latest_metric(changes(spark, sf), ["k", "value1"], "value2", tie_break=["ums_id_"])


def _error_rows(spark, sf):
    """Rows of one event type as failed rows, an hour being a batch and a user group a partition."""
    c = changes(spark, sf).filter("value1 = 'error'").withColumns({
        "topic": F.lit("t"), "part": (F.col("k") % 4).cast("int"),
        "hour": F.date_format("ums_ts_", "yyyyMMddHH")})
    return c


@query("agg_12_error_batches", f"""{W}
    SELECT hour AS batch_id, CAST(sum(n) AS BIGINT) AS n, min(lo) AS min_ts, max(hi) AS max_ts, count(*) AS ranges,
           min(a) AS first_offset, max(z) AS last_offset
    FROM (SELECT strftime(ums_ts_, '%Y%m%d%H') AS hour, k % 4 AS part, count(*) AS n, min(ums_ts_) AS lo, max(ums_ts_) AS hi,
                 min(ums_id_) AS a, max(ums_id_) AS z FROM changes WHERE value1 = 'error' GROUP BY 1, 2) t
    GROUP BY hour""")
def agg_12(spark, sf):
    rows = _error_rows(spark, sf).select(
        F.lit("s").alias("source"), F.lit("d").alias("sink"), F.col("hour").alias("batch_id"),
        F.lit("r").alias("reason"), "ums_ts_", "topic", F.col("part").alias("partition"),
        F.col("ums_id_").alias("offset"))
    return error_batches(rows).select(
        "batch_id", "n", "min_ts", "max_ts", F.size("offsets").cast("long").alias("ranges"),
        F.array_min(F.col("offsets.from_offset")).alias("first_offset"),
        F.array_max(F.col("offsets.until_offset")).alias("last_offset"))


@query("agg_12_flow_errors", f"""{W}
    SELECT CAST(k % 4 AS VARCHAR) AS source, count(*) AS n, count(DISTINCT strftime(ums_ts_, '%Y%m%d%H')) AS batches,
           min(ums_ts_) AS from_ts, max(ums_ts_) AS to_ts FROM changes WHERE value1 = 'error' GROUP BY k % 4""")
def agg_12_flow(spark, sf):
    rows = _error_rows(spark, sf).select(
        F.col("part").cast("string").alias("source"), F.lit("d").alias("sink"),
        F.col("hour").alias("batch_id"), F.lit("r").alias("reason"), "ums_ts_", "topic",
        F.col("part").alias("partition"), F.col("ums_id_").alias("offset"))
    return flow_errors(error_batches(rows)).drop("sink")


@query("srt_01_order_by", """
    SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey""")
def srt_01(spark, sf):
    return table_query(table(spark, sf, "orders"),
                       ["o_orderkey", "o_orderpriority", "o_totalprice"],
                       order_by=["o_orderpriority desc", "o_totalprice", "o_orderkey"])


@query("srt_02_limit", """
    SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50""")
def srt_02(spark, sf):
    return table_query(table(spark, sf, "orders"), ["o_orderkey", "o_totalprice"],
                       order_by=["o_totalprice desc", "o_orderkey"], limit=50, max_rows=200)


@query("stm_14_heartbeat_stats", f"""{W}, n AS (
      SELECT value1 || '_' || CAST(k AS VARCHAR) || '_' || strftime(ums_ts_, '%Y%m%d') AS namespace, ums_ts_, ums_op_
      FROM changes)
    SELECT namespace, CAST(0 AS BIGINT) AS n, max(ums_ts_) AS ums_ts_ FROM n
    WHERE ums_op_ = 'd' AND namespace NOT IN (SELECT namespace FROM n WHERE ums_op_ <> 'd') GROUP BY namespace""")
def stm_14(spark, sf):
    # deletes stand for heartbeats, all other rows for data
    c = changes(spark, sf).withColumn("namespace", F.concat_ws(
        "_", "value1", F.col("k").cast("string"), F.date_format("ums_ts_", "yyyyMMdd")))
    beats = c.withColumn("protocol", F.when(F.col("ums_op_") == "d", "data_increment_heartbeat")
                         .otherwise("data_increment_data"))
    return heartbeat_stats(beats, c.filter("ums_op_ <> 'd'"))


@query("stm_17_error_records", f"""{W}
    SELECT 'src' AS source, 'dst' AS sink, '7' AS batch_id, 'bad value' AS reason,
           '{{"k":' || CAST(k AS VARCHAR) || ',"value1":"' || value1 || '"}}' AS row, 'topic-a' AS topic, ums_id_ AS "offset"
    FROM changes WHERE value1 = 'error'""")
def stm_17(spark, sf):
    bad = changes(spark, sf).filter("value1 = 'error'").withColumn("topic", F.lit("topic-a"))
    return error_records(bad, "bad value", "src", "dst", 7, ["k", "value1"],
                         {"topic": "topic", "offset": "ums_id_"})


_BACKFILL = W + """, r AS (SELECT k % 4 AS part, strftime(ums_ts_, '%Y%m%d%H') AS hour, min(ums_id_) AS a, max(ums_id_) AS z
    FROM changes WHERE value1 = 'error' GROUP BY 1, 2),
  hit AS (SELECT DISTINCT ums_id_, k % 4 AS part FROM changes c WHERE k % 2 = 1 AND EXISTS (
    SELECT 1 FROM r WHERE r.part = c.k % 4 AND c.ums_id_ BETWEEN a AND z))"""


def _log(spark, sf):
    c = changes(spark, sf)
    return c.select(
        F.lit("t").alias("topic"), (F.col("k") % 4).cast("int").alias("partition"),
        F.col("ums_id_").alias("offset"), F.concat(
            F.lit("data_increment_data.s.i.d."), F.when(F.col("k") % 2 == 1, "odd")
            .otherwise("even"), F.lit(".1.0.0")).alias("key"), F.col("props").alias("value"))


def _backfill(spark, sf):
    rows = _error_rows(spark, sf).select(
        F.lit("s").alias("source"), F.lit("d").alias("sink"), F.col("hour").alias("batch_id"),
        F.lit("r").alias("reason"), "ums_ts_", "topic", F.col("part").alias("partition"),
        F.col("ums_id_").alias("offset"))
    return backfill(_log(spark, sf), error_batches(rows), "s.i.d.odd.*.*.*")


@query("stm_18_backfill_messages", f"""{_BACKFILL}
    SELECT ums_id_ AS "offset", CAST(part AS INTEGER) AS partition FROM hit""")
def stm_18(spark, sf):
    return _backfill(spark, sf)[0].select("offset", "partition")


@query("stm_18_backfill_counts", f"""{_BACKFILL}
    SELECT 't' AS topic, CAST(part AS INTEGER) AS partition, count(*) AS n FROM hit GROUP BY part""")
def stm_18_counts(spark, sf):
    return _backfill(spark, sf)[1]


def _shout(s):
    return None if s is None else s.upper() + "!"


@query("udx_01_scalar_udf", "SELECT event_id, upper(event_type) || '!' AS loud FROM events")
def udx_01(spark, sf):
    register_udf(spark, "shout", _shout, "string")
    table(spark, sf, "events").createOrReplaceTempView("udx_events")
    return spark.sql("SELECT event_id, shout(event_type) AS loud FROM udx_events")


@query("udx_02_vectorized_udf", "SELECT event_id, value * 2 + user_id AS score FROM events")
def udx_02(spark, sf):
    import pandas as pd

    def score(v: pd.Series, u: pd.Series) -> pd.Series:
        return v * 2 + u

    register_udf(spark, "score", score, "double", vectorized=True)
    table(spark, sf, "events").createOrReplaceTempView("udx_events")
    return spark.sql("SELECT event_id, score(value, user_id) AS score FROM udx_events")


class WeightedAverage(Udaf):
    """Integer weighted average of (value, weight)."""

    return_type = "long"

    def create_accumulator(self):
        return (0, 0)

    def accumulate(self, acc, value, weight):
        return (acc[0] + int(value) * int(weight), acc[1] + int(weight))

    def merge(self, acc, other):
        return (acc[0] + other[0], acc[1] + other[1])

    def get_value(self, acc):
        return acc[0] // acc[1] if acc[1] else None


_WAVG = """SELECT l_returnflag, l_linestatus, sum(l_partkey * l_linenumber) // sum(l_linenumber) AS wavg
           FROM lineitem GROUP BY l_returnflag, l_linestatus"""


@query("udx_03_udaf_in_sql", _WAVG)
def udx_03(spark, sf):
    register_udaf(spark, "wavg_udaf", WeightedAverage)
    table(spark, sf, "lineitem").createOrReplaceTempView("udx_lineitem")
    return spark.sql("SELECT l_returnflag, l_linestatus, wavg_udaf(l_partkey, l_linenumber) AS wavg "
                     "FROM udx_lineitem GROUP BY l_returnflag, l_linestatus")


@query("udx_03_udaf_in_parts", _WAVG)
def udx_03_parts(spark, sf):
    return aggregate_udaf(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"],
                          WeightedAverage, ["l_partkey", "l_linenumber"], "wavg")


@query("udx_05_built_in_functions", f"""{W}
    SELECT k, min_by(value2, ums_id_) AS head, max_by(value2, ums_id_) AS tail FROM changes GROUP BY k""")
def udx_05(spark, sf):
    from ..plans.registry import BUILT_IN
    order = ["ums_ts_", "ums_id_"]
    return changes(spark, sf).groupBy("k").agg(
        BUILT_IN["firstValue"]("value2", order).alias("head"),
        BUILT_IN["lastValue"]("value2", order).alias("tail"))
