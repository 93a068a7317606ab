"""Streaming operators: STM-*, and the streaming forms of joins and patterns."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from ..operators.lookups import lookup, stream_join
from ..patterns import Output, OutputField, PatternSpec, Stage
from ..session import shared_dir
from ..sources.streams import file_stream
from ..streaming.hold import settle, settle_stream, validity
from ..streaming.run import drain, run_to_idle
from ..streaming.state import match_pattern_stream, running_agg
from ..streaming.totals import ChangingTotals, RunningOver
from ..streaming.windows import key_by, window_agg, with_event_time
from .base import SQL_CHANGES, changes, query, table
from .joins import NEAR_SECONDS, NEAR_SQL
from .patterns import is_

W = "WITH " + SQL_CHANGES


def event_stream(spark, sf, lateness: int = 0):
    """The events table as a stream, in the columns of the change log, with a watermark."""
    # a glob, so that the table may be one file or a folder
    raw = file_stream(spark, f"{sf}/events.parque[t]", table(spark, sf, "events").schema)
    last = F.col("event_id") % 10
    rows = raw.select(
        F.col("event_id").alias("ums_id_"), F.col("ts").cast("timestamp").alias("ums_ts_"),
        F.when(last == 9, "d").when(last >= 5, "u").otherwise("i").alias("ums_op_"),
        F.col("user_id").alias("k"), F.col("event_type").alias("value1"),
        F.col("value").alias("value2"))
    return with_event_time(rows, "event", lateness)


def _aggs():
    return {"n": F.count(F.lit(1)), "top": F.max("value2")}


def _tumble(extra: str = "") -> str:
    return f"""{W} SELECT value1, time_bucket(INTERVAL 6 HOUR, ums_ts_) AS window_start,
      time_bucket(INTERVAL 6 HOUR, ums_ts_) + INTERVAL 6 HOUR AS window_end, count(*) AS n, max(value2) AS top
      FROM changes GROUP BY 1, 2, 3 {extra}"""


_CLOSED = "HAVING time_bucket(INTERVAL 6 HOUR, ums_ts_) + INTERVAL 6 HOUR <= (SELECT date_trunc('milliseconds', max(ums_ts_)) {0} FROM changes)"


@query("stm_01_processing_time", f"{W} SELECT ums_id_, TRUE AS stamped FROM changes")
def stm_01(spark, sf):
    df = with_event_time(changes(spark, sf), "processing")
    return df.select("ums_id_", F.col("processing_time").isNotNull().alias("stamped"))


@query("stm_02_ascending_watermark_stream", _tumble(_CLOSED.format("")))
def stm_02(spark, sf):
    return drain(window_agg(event_stream(spark, sf), "tumble", "6 hours", _aggs(), ["value1"])) \
        .drop("_batch")


@query("stm_03_bounded_lateness_stream", _tumble(_CLOSED.format("- INTERVAL 86400 SECOND")))
def stm_03(spark, sf):
    return drain(window_agg(event_stream(spark, sf, 86400), "tumble", "6 hours", _aggs(),
                            ["value1"])).drop("_batch")


@query("stm_04_tumbling_window", _tumble())
def stm_04(spark, sf):
    return window_agg(changes(spark, sf), "tumble", "6 hours", _aggs(), ["value1"])


_HOP = W + """, b AS (SELECT value1, value2, ums_ts_, time_bucket(INTERVAL 2 HOUR, ums_ts_) - o.unnest * INTERVAL 2 HOUR AS window_start
      FROM changes, UNNEST([0, 1, 2]) o)
    SELECT value1, window_start, window_start + INTERVAL 6 HOUR AS window_end, count(*) AS n, max(value2) AS top
    FROM b GROUP BY 1, 2, 3"""


@query("stm_05_sliding_window", _HOP)
def stm_05(spark, sf):
    return window_agg(changes(spark, sf), "hop", "6 hours", _aggs(), ["value1"], slide="2 hours")


@query("stm_05_sliding_window_stream", _HOP + """
    HAVING window_start + INTERVAL 6 HOUR <= (SELECT date_trunc('milliseconds', max(ums_ts_)) FROM changes)""")
def stm_05_stream(spark, sf):
    return drain(window_agg(event_stream(spark, sf), "hop", "6 hours", _aggs(), ["value1"],
                            slide="2 hours")).drop("_batch")


_SESSION = W + """, m AS (SELECT *, CASE WHEN ums_ts_ - lag(ums_ts_) OVER w < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS opens
      FROM changes WINDOW w AS (PARTITION BY k ORDER BY ums_ts_)),
    g AS (SELECT *, sum(opens) OVER (PARTITION BY k ORDER BY ums_ts_) AS s FROM m)
    SELECT k, min(ums_ts_) AS window_start, max(ums_ts_) + INTERVAL 4 HOUR AS window_end, count(*) AS n, max(value2) AS top
    FROM g GROUP BY k, s"""


@query("stm_06_session_window", _SESSION)
def stm_06(spark, sf):
    return window_agg(changes(spark, sf), "session", "4 hours", _aggs(), ["k"])


@query("stm_06_session_window_stream", _SESSION + """
    HAVING max(ums_ts_) + INTERVAL 4 HOUR <= (SELECT date_trunc('milliseconds', max(ums_ts_)) FROM changes)""")
def stm_06_stream(spark, sf):
    return drain(window_agg(event_stream(spark, sf), "session", "4 hours", _aggs(), ["k"])) \
        .drop("_batch")


@query("stm_07_running_agg_stream", f"""{W}
    SELECT k, count(*) AS n, max(value2) AS top, min(ums_id_) AS low FROM changes GROUP BY k""")
def stm_07(spark, sf):
    out = drain(running_agg(event_stream(spark, sf), ["k"], {
        "n": ("count", ""), "top": ("max", "value2"), "low": ("min", "ums_id_")}), mode="update")
    # an updating result: the last emission of a key counts
    return out.groupBy("k").agg(*[F.max_by(c, "_batch").alias(c) for c in ("n", "top", "low")])


@query("stm_07_change_flag_stream", f"""{W}
    SELECT k, count(*) AS added, count(*) - 1 AS retracted, count(*) AS last_n FROM changes GROUP BY k""")
def stm_07_flag(spark, sf):
    events = event_stream(spark, sf)
    out = drain(events, through=ChangingTotals(
        events, shared_dir(spark, "totals"), ["k"], {"n": ("count", "")}, buckets=8))
    return out.groupBy("k").agg(
        F.count_if("message_flag").alias("added"), F.count_if(~F.col("message_flag"))
        .alias("retracted"), F.max("n").alias("last_n"))


@query("stm_08_running_over_stream", f"""{W}, o AS (
      SELECT ums_id_, ums_ts_, count(*) OVER w AS n, max(value2) OVER w AS top, first_value(value2) OVER w AS head
      FROM changes WINDOW w AS (PARTITION BY k ORDER BY ums_ts_, ums_id_ ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
    SELECT ums_id_, n, top, head FROM o WHERE epoch_us(ums_ts_) // 1000 + 1 <= (SELECT epoch_us(max(ums_ts_)) // 1000 FROM changes)""")
def stm_08(spark, sf):
    events = event_stream(spark, sf)
    return drain(events, through=RunningOver(events, shared_dir(spark, "over"), ["k"], {
        "n": ("count", ""), "top": ("max", "value2"), "head": ("first", "value2")}, preceding=3,
        buckets=8)) \
        .select("ums_id_", "n", "top", "head")


@query("stm_10_key_by", f"{W} SELECT k, value1, count(*) AS n FROM changes GROUP BY k, value1")
def stm_10(spark, sf):
    # partitioned by k, so the aggregate by (k, value1) needs no further exchange
    return key_by(changes(spark, sf), ["k"]).groupBy("k", "value1") \
        .agg(F.count(F.lit(1)).alias("n"))


@query("stm_11_validity", f"""{W}, j AS (SELECT ums_id_, ums_ts_, c_name, value1 FROM changes
      LEFT JOIN customer ON k = CASE WHEN c_nationkey < 12 THEN c_custkey END)
    SELECT ums_id_, CASE WHEN c_name IS NOT NULL AND value1 <> '' THEN 'send'
      WHEN date_trunc('second', ums_ts_) <= date_trunc('second', (SELECT min(ums_ts_) FROM j WHERE ums_ts_ >= (SELECT max(ums_ts_) FROM j) - INTERVAL 864000 SECOND)) - INTERVAL 300 SECOND THEN 'alert' ELSE 'hold' END AS fate FROM j""")
def stm_11(spark, sf):
    some = table(spark, sf, "customer").withColumn(
        "some", F.when(F.col("c_nationkey") < 12, F.col("c_custkey")))
    df = lookup(changes(spark, sf), some, [("k", "some")], "left", columns=["c_name"])
    # the newest batch is the last ten days, the rows before it were held
    newest = df.filter(F.col("ums_ts_") >= df.agg(F.max("ums_ts_").alias("t")).scalar()
                       - F.expr("INTERVAL 864000 SECONDS"))
    out = validity(df, ["c_name", "value1"], "and", 300, "alert",
                   min_ts=newest.agg(F.min("ums_ts_").alias("t")).scalar())
    return out.select("ums_id_", F.col("_fate").alias("fate"))


_SETTLE = W + """, u AS (SELECT k, value1, strftime(ums_ts_, '%Y%m%d%H') AS h, min(date_trunc('hour', ums_ts_)) AS t FROM changes GROUP BY 1, 2, 3)
    SELECT k, value1, h, t <= (SELECT max(date_trunc('hour', ums_ts_)) FROM changes) - INTERVAL 172800 SECOND AS released FROM u"""


@query("stm_13_settle", _SETTLE)
def stm_13(spark, sf):
    c = changes(spark, sf).select("k", "value1", F.date_format("ums_ts_", "yyyyMMddHH").alias("h"),
                                  F.date_trunc("hour", "ums_ts_").alias("t"), "ums_op_")
    buffer = c.filter("ums_op_ <> 'i'").drop("ums_op_")
    new = c.filter("ums_op_ = 'i'").drop("ums_op_")
    out = settle(new, buffer, ["k", "value1", "h"], 172800, "t")
    return out.select("k", "value1", "h", F.col("_released").alias("released"))


@query("stm_13_settle_stream", f"""{W}, u AS (SELECT k, value1, strftime(ums_ts_, '%Y%m%d%H') AS h, min(date_trunc('hour', ums_ts_)) AS t FROM changes GROUP BY 1, 2, 3)
    SELECT k, value1, h, t FROM u
    WHERE t <= (SELECT max(date_trunc('hour', ums_ts_)) FROM changes) - INTERVAL 172800 SECOND""")
def stm_13_stream(spark, sf):
    c = changes(spark, sf).select("k", "value1", F.date_format("ums_ts_", "yyyyMMddHH").alias("h"),
                                  F.date_trunc("hour", "ums_ts_").alias("t"))
    # the log arrives in files, older ones first
    path, parts = shared_dir(spark, "settle-in"), 3
    ends = c.agg(F.min("t").alias("a"), F.max("t").alias("b"))
    step = (F.unix_timestamp("b") - F.unix_timestamp("a")) / parts + 1
    part = F.floor((F.unix_timestamp("t") - F.unix_timestamp("a")) / step)
    numbered = c.crossJoin(F.broadcast(ends)).select(*c.columns, part.alias("part"))
    for i in range(parts):
        numbered.filter(F.col("part") == i).drop("part").write.mode("append").parquet(path)
    files = len(spark.read.parquet(path).inputFiles())
    arriving = file_stream(spark, path, c.schema, files_per_batch=-(-files // parts))
    return drain(settle_stream(arriving, ["k", "value1", "h"], 172800, "t")).drop("_batch")


#: seconds of the clock after which an idle key is forgotten, in stm_09
IDLE_SECONDS = 4


@query("stm_09_idle_state_stream", f"""{W}
    SELECT k, count(*) FILTER (WHERE ums_id_ % 2 = 0) AS n_before, count(*) FILTER (WHERE ums_id_ % 2 = 0) > 0 AS stored,
      count(*) FILTER (WHERE ums_id_ % 2 = 1) AS n_after FROM changes GROUP BY k""")
def stm_09(spark, sf):
    c = changes(spark, sf).select("ums_id_", "k")
    path, checkpoint = shared_dir(spark, "idle-in"), shared_dir(spark, "idle-checkpoint")
    seen = []
    for half in (0, 1):
        c.filter(F.col("ums_id_") % 2 == half).write.mode("append").parquet(path)
        counts = running_agg(file_stream(spark, path, c.schema), ["k"], {"n": ("count", "")},
                             idle_hours=IDLE_SECONDS / 3600)
        out, batch = run_to_idle(counts, checkpoint, "update")
        if not half:
            # what the store held after the batch that read the rows
            held = spark.read.format("statestore").option("path", checkpoint).option(
                "stateVarName", "acc").option("batchId", batch).load() \
                .select(F.col("key.k").alias("k"), F.lit(True).alias("stored"))
            time.sleep(IDLE_SECONDS + 1)
        seen.append(out.groupBy("k").agg(F.max("n").alias(("n_before", "n_after")[half])))
    return seen[0].join(seen[1], "k", "full").join(held, "k", "full").select(
        "k", F.coalesce("n_before", F.lit(0)).alias("n_before"),
        F.coalesce("stored", F.lit(False)).alias("stored"),
        F.coalesce("n_after", F.lit(0)).alias("n_after"))


@query("jon_13_stream_lookup", f"""{W}
    SELECT ums_id_, k, c_name FROM changes LEFT JOIN customer ON k = c_custkey""")
def jon_13(spark, sf):
    return drain(lookup(event_stream(spark, sf), table(spark, sf, "customer"),
                        [("k", "c_custkey")], "left", columns=["c_name"])) \
        .select("ums_id_", "k", "c_name")


@query("jon_14_stream_join_stream", NEAR_SQL)
def jon_14_stream(spark, sf):
    left, right = event_stream(spark, sf, 3600), event_stream(spark, sf, 3600)
    return drain(stream_join(left, right, [("k", "k")], NEAR_SECONDS,
                             columns={"ums_id_": "other_id"})).select("ums_id_", "other_id")


@query("cep_01_pattern_stream", f"""{W}, e AS (SELECT k, ums_id_, ums_ts_, value1, lead(value1) OVER w AS nx, lead(ums_id_) OVER w AS id_next, lead(ums_ts_) OVER w AS t_next
      FROM changes WINDOW w AS (PARTITION BY k ORDER BY ums_ts_, ums_id_))
    SELECT k, ums_id_ AS first_id, id_next AS last_id FROM e WHERE value1 = 'view' AND nx = 'click'
      AND epoch_us(t_next) // 1000 + 1 <= (SELECT epoch_us(max(ums_ts_)) // 1000 FROM changes)""")
def cep_01_stream(spark, sf):
    spec = PatternSpec((Stage("begin", is_("view")), Stage("next", is_("click"))), ("k",),
                       output=Output("agg", (OutputField("head", "ums_id_", "first_id"),
                                             OutputField("last", "ums_id_", "last_id"))))
    return drain(match_pattern_stream(event_stream(spark, sf), spec)) \
        .select("k", "first_id", "last_id")
