"""Entry points and hooks as registered queries: flows with a gate, error policy, restarts,
custom sources, sinks and transforms, and sequences with null times and values."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, functions as F

from ..functions.times import dated_name
from ..model import FlowSpec, Sink, Validity
from ..operators.blocks import running_total
from ..operators.changes import apply_changes, to_target
from ..patterns import Output, PatternSpec, Stage
from ..plans.flow import JobSpec, run_job
from ..plans.registry import register_transform
from ..plans.steps import CustomStep, LookupStep, PatternStep, run_steps
from ..session import shared_dir
from ..sinks.bucketed import BucketedTable
from ..sinks.versions import VersionedTable
from ..sinks.write import register_sink, write_all
from ..sources.parts import PartFiles, register_format
from ..sources.ext_json import infer_ext_schema, read_ext_json
from ..sources.tables import read_source, register_source
from ..streaming.flows import flows_writer
from ..streaming.run import drain
from ..streaming.totals import RunningOver
from .base import FIELDS, SQL_CHANGES, changes, days, messages, query, table
from .patterns import is_
from .streams import event_stream

W = "WITH " + SQL_CHANGES


# -- flows with a gate -----------------------------------------------------------------


def _to_folder(path: str):
    def write(df: DataFrame, sink: Sink, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/{sink.name}/batch={batch_id}")
    return write


def _two_batches(spark, sf) -> str:
    """Even ids first, then odd ones with what was held; customers fill up in between."""
    out, customer = shared_dir(spark, "flows"), table(spark, sf, "customer")
    known = F.when(F.col("c_nationkey") < 12, F.col("c_custkey"))
    for number in (0, 1):
        key = known if number == 0 else F.col("c_custkey")
        names = customer.select(key.alias("known"), "c_name")
        gate = FlowSpec("s.i.d.t", [LookupStep(names, [("k", "known")], "left", ["c_name"])],
                        Sink(_to_folder(out), "gated", mutation="i"),
                        validity=Validity(["c_name"], "and", "timeout", 0, "drop"), name="gate")
        merge = FlowSpec("s.i.d.t", [], Sink(_to_folder(out), "merged", keys=["k"]), name="merge")
        batch = changes(spark, sf).drop("props").filter(F.col("ums_id_") % 2 == number)
        flows_writer([gate, merge], "interrupt", held={"gate": f"{out}/held"})(batch, number)
    return out


_GATED = f"""{W},
    first AS (SELECT ums_id_, ums_ts_, k, c_name FROM changes
              LEFT JOIN customer ON k = CASE WHEN c_nationkey < 12 THEN c_custkey END
              WHERE ums_id_ % 2 = 0),
    held AS (SELECT ums_id_, k FROM first WHERE c_name IS NULL AND date_trunc('second', ums_ts_)
             > (SELECT date_trunc('second', min(ums_ts_)) FROM first)),
    second AS (SELECT ums_id_, k FROM held
               UNION ALL SELECT ums_id_, k FROM changes WHERE ums_id_ % 2 = 1)
    SELECT ums_id_, c_name, 0 AS batch FROM first WHERE c_name IS NOT NULL
    UNION ALL SELECT ums_id_, c_name, 1 FROM second JOIN customer ON k = c_custkey"""


@query("stm_12_held_rows_join_the_next_batch", _GATED)
def stm_12(spark, sf):
    return spark.read.parquet(f"{_two_batches(spark, sf)}/gated").select(
        "ums_id_", "c_name", F.col("batch").cast("int").alias("batch"))


@query("stm_15_flows_merge_by_key", f"""{W}
    SELECT k, ums_id_, value1, batch FROM (
      SELECT *, ums_id_ % 2 AS batch,
             row_number() OVER (PARTITION BY k, ums_id_ % 2 ORDER BY ums_id_ DESC) AS rn FROM changes)
    WHERE rn = 1""")
def stm_15(spark, sf):
    return spark.read.parquet(f"{_two_batches(spark, sf)}/merged").select(
        "k", "ums_id_", "value1", F.col("batch").cast("long").alias("batch"))


@query("stm_16_error_feedback", """
    SELECT 'cell does not convert' AS reason, count(*) AS n FROM events WHERE event_id % 5 = 0
    UNION ALL SELECT 'message does not decode', count(*) FROM events WHERE event_id % 5 = 1
    UNION ALL SELECT 'written', count(*) FROM events WHERE event_id % 5 > 1""")
def stm_16(spark, sf):
    out = shared_dir(spark, "feedback")
    number = F.get_json_object("value", "$.payload[0].tuple[0]").cast("long") % 5
    broken = F.when(number == 0, F.regexp_replace("value", r'"tuple":\["\d+"', '"tuple":["x"')) \
        .when(number == 1, F.substring("value", 1, 40)).otherwise(F.col("value"))
    batch = messages(spark, sf).withColumn("value", broken)
    flow = FlowSpec("kafka.k01.db.events.*.*.*", [], Sink(_to_folder(out), "good", mutation="i"),
                    FIELDS)
    flows_writer([flow], "feedback", lambda df, n: df.select("reason").write.mode("append")
                 .parquet(f"{out}/errors"))(batch, 0)
    good = spark.read.parquet(f"{out}/good").select(F.lit("written").alias("reason"))
    return spark.read.parquet(f"{out}/errors").unionByName(good).groupBy("reason").agg(
        F.count(F.lit(1)).alias("n"))


@query("stm_19_restart_from_checkpoint", f"{W} SELECT ums_id_, k FROM changes")
def stm_19(spark, sf):
    checkpoint, out = shared_dir(spark, "checkpoint"), shared_dir(spark, "out")
    stream = event_stream(spark, sf).select("ums_id_", "k")
    drain(stream, checkpoint=checkpoint, out=out)
    # the second run finds nothing new
    return drain(stream, checkpoint=checkpoint, out=out).drop("_batch")


# -- hooks -----------------------------------------------------------------------------


@query("src_19_custom_source", """
    SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00'""")
def src_19(spark, sf):
    register_source("events_from", lambda s, start, end, ns, connection, options: s.read.parquet(
        options["path"]).filter(F.col("ts") >= F.lit(start).cast("timestamp")))
    return read_source(spark, "events_from", "2024-01-10 00:00:00",
                       options={"path": f"{sf}/events.parquet"}).select("event_id", "user_id")


def part_files(spark, df: DataFrame, path: str, mode: str = "append") -> None:
    register_format(spark, "part_files", PartFiles)
    df.write.format("part_files").option("range_column", "ums_id_").mode(mode).save(path)


@query("src_19_custom_format", f"""{W}
    SELECT ums_id_, k, value1 FROM changes WHERE ums_id_ >= (SELECT max(ums_id_) // 2 FROM changes)""")
def src_19_format(spark, sf):
    path = shared_dir(spark, "part-files")
    df = changes(spark, sf).select("ums_id_", "k", "value1")
    # parts that hold ranges of ids, so that a filter leaves some of them out
    part_files(spark, df.repartitionByRange(8, "ums_id_"), path)
    middle = df.agg(F.max("ums_id_").alias("m")).first()["m"] // 2
    return spark.read.format("part_files").option("range_column", "ums_id_").load(path) \
        .filter(F.col("ums_id_") >= middle)


@query("src_20_rows_by_inferred_schema", """
    SELECT event_id AS id, user_id AS "user", event_type AS kind,
           CASE WHEN event_id % 3 <> 0 THEN event_id + 1 END AS after FROM events""")
def src_20(spark, sf):
    text = F.to_json(F.struct(
        F.col("event_id").alias("id"),
        F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("kind")).alias("who"),
        F.when(F.col("event_id") % 3 != 0, F.col("event_id") + 1).alias("after")),
        {"ignoreNullFields": "false"})
    texts = table(spark, sf, "events").select(text.alias("value"))
    rows = read_ext_json(texts, "value", infer_ext_schema(texts, "value"))
    return rows.select("id", "user", "kind", "after")


@query("snk_21_several_sinks", f"""{W}
    SELECT sink, k, count(*) AS n FROM changes, (VALUES ('one'), ('two')) s(sink) GROUP BY sink, k""")
def snk_21(spark, sf):
    out = shared_dir(spark, "fan-out")
    write_all(changes(spark, sf).select("ums_id_", "k"), {
        name: lambda df, name=name: df.write.parquet(f"{out}/sink={name}")
        for name in ("one", "two")}, parallel=True)
    return spark.read.parquet(out).groupBy("sink", "k").agg(F.count(F.lit(1)).alias("n"))


@query("snk_22_custom_sink", f"{W} SELECT ums_id_, k * 2 AS kk FROM changes")
def snk_22(spark, sf):
    out = shared_dir(spark, "custom-sink")
    register_sink("doubled", lambda df, spec: df.select("ums_id_", (F.col("k") * 2).alias("kk"))
                  .write.parquet(spec.options["path"]))
    run_job(spark, JobSpec(changes(spark, sf), sink="doubled", options={"path": out}))
    return spark.read.parquet(out)


@query("snk_22_custom_format", f"{W} SELECT ums_id_, k * 2 AS kk FROM changes")
def snk_22_format(spark, sf):
    path = shared_dir(spark, "part-files")
    df = changes(spark, sf).select("ums_id_", (F.col("k") * 2).alias("kk")) \
        .repartitionByRange(8, "ums_id_")
    top = df.agg(F.max("ums_id_").alias("m")).first()["m"]
    broken = df.withColumn("kk", F.when(F.col("ums_id_") == top, F.raise_error(F.lit("stop"))
                                        .cast("long")).otherwise(F.col("kk")))
    try:    # a job whose last task fails leaves nothing that a reader sees
        part_files(spark, broken, path)
    except PySparkException:
        pass
    part_files(spark, df, path)
    return spark.read.format("part_files").load(path)


@query("udx_04_custom_transform", f"{W} SELECT k, count(*) AS n FROM changes GROUP BY k")
def udx_04(spark, sf):
    register_transform("count_by", lambda s, df, spec, param: df.groupBy(param).agg(
        F.count(F.lit(1)).alias("n")))
    return run_steps(changes(spark, sf), [CustomStep("count_by", "k")])


@query("dat_05_name_of_day", "SELECT event_id, 'log_' || strftime(ts, '%Y%m%d') AS name FROM events")
def dat_05(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", dated_name("log_", "date_nod", F.to_date("ts")).alias("name"))


# -- null times, null values, long numbers -----------------------------------------------


_NULLS = f"""{W}, n AS (
      SELECT ums_id_, k, CASE WHEN ums_id_ % 10 <> 0 THEN ums_ts_ END AS seen,
             CASE WHEN ums_id_ % 4 <> 0 AND ums_id_ > 200 THEN ums_id_ END AS v FROM changes)
    SELECT ums_id_, size, sum(v) OVER (PARTITION BY size, k ORDER BY seen NULLS FIRST, ums_id_
                                       ROWS UNBOUNDED PRECEDING)::BIGINT AS total
    FROM n, (VALUES ('small'), ('default')) s(size)"""


@query("win_02_total_with_nulls", _NULLS)
def win_02_nulls(spark, sf):
    i = F.col("ums_id_")
    rows = changes(spark, sf).select("ums_id_", "k", F.when(i % 10 != 0, F.col("ums_ts_"))
                                     .alias("at"), F.when((i % 4 != 0) & (i > 200), i).alias("v"))

    def total(size: str, **kw) -> DataFrame:
        return running_total(rows, ["k"], ["at", "ums_id_"], "v", "total", **kw).select(
            "ums_id_", F.lit(size).alias("size"), "total")
    return total("small", block_rows=5).unionByName(total("default"))


@query("stm_08_exact_longs_stream", f"""{W}, o AS (
      SELECT ums_id_, ums_ts_, max(CASE WHEN ums_id_ % 3 <> 0 THEN 9007199254740993 + ums_id_ END) OVER w AS top
      FROM changes WINDOW w AS (PARTITION BY k ORDER BY ums_ts_, ums_id_ ROWS BETWEEN 1 PRECEDING AND CURRENT ROW))
    SELECT ums_id_, top FROM o WHERE epoch_us(ums_ts_) // 1000 + 1 <= (SELECT epoch_us(max(ums_ts_)) // 1000 FROM changes)""")
def stm_08_exact(spark, sf):
    big = F.when(F.col("ums_id_") % 3 != 0, F.lit(9007199254740993) + F.col("ums_id_"))
    rows = event_stream(spark, sf).withColumn("big", big)
    return drain(rows, through=RunningOver(rows, shared_dir(spark, "over"), ["k"], {
        "top": ("max", "big")}, preceding=1, buckets=8)).select("ums_id_", "top")


_HOURS_12 = 43_200


@query("cep_19_timeout_stream", f"""{W},
    f AS (SELECT *, (SELECT min((c.ums_ts_, c.ums_id_)) FROM changes c WHERE c.k = a.k
                     AND c.value1 = 'purchase' AND (c.ums_ts_, c.ums_id_) > (a.ums_ts_, a.ums_id_)) AS nx
          FROM changes a WHERE value1 = 'view')
    SELECT ums_id_, k, value1 FROM f
    WHERE (nx IS NULL OR epoch_us(nx[1]) - epoch_us(ums_ts_) >= {_HOURS_12}000000)
      AND epoch_us(ums_ts_) // 1000 + {_HOURS_12}000 < (SELECT epoch_us(max(ums_ts_)) // 1000 FROM changes)""")
def cep_19_stream(spark, sf):
    spec = PatternSpec((Stage("begin", is_("view")), Stage("followedby", is_("purchase"))), ("k",),
                       within_seconds=_HOURS_12, output=Output("timeout"))
    rows = event_stream(spark, sf)
    found = run_steps(rows, [PatternStep(spec)])
    return drain(found).select("ums_id_", "k", "value1")


@query("cdc_06_null_stored_versions", f"""{W},
    latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ums_id_ DESC) AS rn
               FROM changes) WHERE rn = 1),
    old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ums_id_ DESC) AS rn
            FROM changes WHERE ums_id_ % 2 = 0) WHERE rn = 1),
    stored AS (SELECT k, CASE WHEN k % 3 <> 0 THEN ums_id_ END AS ums_id_, value1 FROM old)
    SELECT coalesce(l.k, s.k) AS k,
           CASE WHEN l.k IS NULL OR s.ums_id_ >= l.ums_id_ THEN s.ums_id_ ELSE l.ums_id_ END AS ums_id_,
           CASE WHEN l.k IS NULL OR s.ums_id_ >= l.ums_id_ THEN s.value1 ELSE l.value1 END AS value1
    FROM latest l FULL JOIN stored s ON l.k = s.k""")
def cdc_06_nulls(spark, sf):
    log = changes(spark, sf).select("ums_id_", "ums_ts_", "ums_op_", "k", "value1")
    stored = to_target(log.filter("ums_id_ % 2 = 0"), ["k"])
    stored = stored.withColumn("ums_id_", F.when(F.col("k") % 3 != 0, F.col("ums_id_")))
    return apply_changes(stored, log, ["k"]).select("k", "ums_id_", "value1")


@query("cdc_06_durable_upsert", f"""{W}
    SELECT k, ums_id_, value1, CASE WHEN ums_op_ = 'd' THEN 0 ELSE 1 END AS ums_active_
    FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ums_id_ DESC) AS rn FROM changes)
    WHERE rn = 1""")
def cdc_06_durable(spark, sf):
    log = changes(spark, sf).select("ums_id_", "ums_ts_", "ums_op_", "k", "value1")
    store = VersionedTable(spark, shared_dir(spark, "versions"), ["k"], buckets=16)
    # three batches out of order, the second one given twice
    for batch, rest in ((0, 1), (1, 2), (1, 2), (2, 0)):
        store.upsert(log.filter(F.col("ums_id_") % 3 == rest), batch)
    return store.read().select("k", "ums_id_", "value1", "ums_active_")


@query("cdc_06_bucketed_upsert", f"""{W}
    SELECT k, day, ums_id_, value1, CASE WHEN ums_op_ = 'd' THEN 0 ELSE 1 END AS ums_active_
    FROM (SELECT *, row_number() OVER (PARTITION BY k, day ORDER BY ums_id_ DESC) AS rn
          FROM (SELECT *, strftime(ums_ts_, '%Y-%m-%d') AS day FROM changes))
    WHERE rn = 1""")
def cdc_06_bucketed(spark, sf):
    log = days(spark, sf)
    # few buckets and little room in them, so that they split
    store = BucketedTable(spark, shared_dir(spark, "bucketed"), ["k", "day"], buckets=2,
                          bucket_rows=500)
    for batch, rest in ((0, 1), (1, 2), (1, 2), (2, 0)):
        store.upsert(log.filter(F.col("ums_id_") % 3 == rest), batch)
    return store.read().select("k", "day", "ums_id_", "value1", "ums_active_")
