import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from changeloom.model import Field, FlowSpec, Sink, Validity
from changeloom.operators.changes import apply_changes, snapshot, to_target
from changeloom.operators.lookups import lookup
from changeloom.plans.flow import JobSpec, decode, run_flow, run_job
from changeloom.plans.steps import SqlStep
from changeloom.sources.streams import file_stream
from changeloom.streaming.flows import FlowFailure, flows_writer
from changeloom.streaming.hold import (gated_writer, held_store, settle, settle_stream,
                                       settling_writer, validity)
from changeloom.streaming.run import drain, run_to_idle, start
from changeloom.streaming.state import running_agg
from changeloom.streaming.totals import ChangingTotals, RunningOver
from changeloom.streaming.windows import window_agg, with_event_time

SCHEMA = "ums_id_ long, ums_ts_ timestamp, ums_op_ string, ums_uid_ string, k long, v long"


def write_files(spark, path, groups):
    """One parquet file per group of (id, second, op, k, v), in file order."""
    for n, rows in enumerate(groups):
        df = spark.createDataFrame(rows, "i long, s long, op string, k long, v long").select(
            F.col("i").alias("ums_id_"), F.timestamp_seconds("s").alias("ums_ts_"),
            F.col("op").alias("ums_op_"), F.col("i").cast("string").alias("ums_uid_"), "k", "v")
        df.coalesce(1).write.mode("append").parquet(f"{path}/{n:03d}")
    return f"{path}/*"


def stream(spark, path, lateness=None):
    df = file_stream(spark, path, SCHEMA, files_per_batch=1)
    return with_event_time(df, "event", lateness) if lateness is not None else df


END = 10_000_000


def test_late_rows_and_windows(spark, tmp_path):
    groups = [[(1, 5, "i", 1, 1), (2, 70, "i", 1, 1)], [(3, 130, "i", 1, 1)],
              [(4, 10, "i", 1, 1)],                       # late: its window is closed
              [(9, END, "i", 9, 1)]]
    path = write_files(spark, str(tmp_path / "in"), groups)
    out = drain(window_agg(stream(spark, path, 0), "tumble", "60 seconds",
                           {"n": F.count(F.lit(1))}, ["k"]))
    got = {(r["k"], int(r["window_start"].replace(tzinfo=dt.timezone.utc).timestamp())): r["n"]
           for r in out.collect()}
    assert got == {(1, 0): 1, (1, 60): 1, (1, 120): 1}
    patient = drain(window_agg(stream(spark, path, 600), "tumble", "60 seconds",
                               {"n": F.count(F.lit(1))}, ["k"]))
    assert {r["n"] for r in patient.filter("k = 1 and window_start < '1970-01-01 00:01:00'")
            .collect()} == {2}


def test_running_over_orders_late_files(spark, tmp_path):
    groups = [[(1, 5, "i", 1, 10), (4, 40, "i", 1, 40)], [(3, 30, "i", 1, 30), (2, 20, "i", 1, 20)],
              [(9, END, "i", 9, 1)]]
    path = write_files(spark, str(tmp_path / "in"), groups)
    rows = stream(spark, path)
    out = drain(rows, through=RunningOver(rows, str(tmp_path / "state"), ["k"], {
        "total": ("sum", "v"), "head": ("first", "v")}, lateness=600, buckets=4))
    assert [(r["ums_id_"], r["total"], r["head"]) for r in out.filter("k = 1").orderBy("ums_id_")
            .collect()] == [(1, 10, 10), (2, 30, 10), (3, 60, 10), (4, 100, 10)]


def test_change_flag_pairs(spark, tmp_path):
    path = write_files(spark, str(tmp_path / "in"), [[(1, 1, "i", 1, 5)], [(2, 2, "i", 1, 7)]])
    rows = stream(spark, path)
    out = drain(rows, through=ChangingTotals(rows, str(tmp_path / "totals"), ["k"], {
        "s": ("sum", "v"), "a": ("avg", "v")}, buckets=4))
    assert sorted((r["_batch"], r["message_flag"], r["s"]) for r in out.collect()) == \
        [(0, True, 5), (1, False, 5), (1, True, 12)]


def test_restart_resumes_from_the_checkpoint(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    path = write_files(spark, source, [[(1, 1, "i", 1, 1)]])
    drain(stream(spark, path), checkpoint=checkpoint, out=out)
    spark.createDataFrame([(2, 1, "i", 1, 1)], "i long, s long, op string, k long, v long").select(
        F.col("i").alias("ums_id_"), F.timestamp_seconds("s").alias("ums_ts_"),
        F.col("op").alias("ums_op_"), F.col("i").cast("string").alias("ums_uid_"), "k", "v") \
        .write.parquet(f"{source}/001")
    rows = drain(stream(spark, path), checkpoint=checkpoint, out=out).collect()
    # the first file is not read again, and the later batch has a later number
    assert [r["ums_id_"] for r in sorted(rows, key=lambda r: r["_batch"])] == [1, 2]


def test_validity_gate_holds_and_retries(spark, tmp_path):
    names = str(tmp_path / "names")
    spark.createDataFrame([(1, "one")], "key long, name string").write.parquet(names)
    sent, alerts = [], []

    def transform(df):
        return lookup(df, spark.read.parquet(names), [("k", "key")], "left", columns=["name"])

    def write(df, batch_id):
        sent.append(sorted(r["ums_id_"] for r in df.collect()))
        if batch_id == 0:      # the missing name arrives after the first batch
            spark.createDataFrame([(2, "two")], "key long, name string") \
                .write.mode("append").parquet(names)

    path = write_files(spark, str(tmp_path / "in"), [
        [(1, 100, "i", 1, 0), (2, 101, "i", 2, 0), (3, 102, "i", 3, 0)],
        [(4, 120, "i", 1, 0)], [(5, 500, "i", 1, 0)]])
    source = stream(spark, path)
    held = held_store(source, str(tmp_path / "held"))
    writer = gated_writer(Validity(["name"], timeout_seconds=60, action="alert"), transform, write,
                          held, alert=lambda df, n: alerts.append(
                              [r["ums_id_"] for r in df.collect()]))
    start(source, writer, str(tmp_path / "cp")).awaitTermination()
    assert sent == [[1], [2, 4], [5]]
    assert alerts == [[], [], [3]]


def test_validity_rules(spark):
    df = spark.createDataFrame([(1, "", None), (2, "x", None), (3, "x", "y")],
                               "i long, a string, b string") \
        .withColumn("ums_ts_", F.timestamp_seconds(F.col("i") * 100))

    def fates(**kw):
        return {r["i"]: r["_fate"] for r in validity(df, ["a", "b"], **kw).collect()}

    assert fates(timeout_seconds=0) == {1: "drop", 2: "hold", 3: "send"}
    assert fates(rule="or", timeout_seconds=10) == {1: "hold", 2: "send", 3: "send"}
    assert fates(timeout_seconds=0, action="send")[1] == "send"


def test_settling_stream(spark, tmp_path):
    released = {}
    path = write_files(spark, str(tmp_path / "in"), [
        [(1, 10, "i", 1, 0), (1, 10, "i", 1, 0), (2, 95, "i", 2, 0)],
        [(2, 95, "i", 2, 0), (3, 200, "i", 3, 0)]])
    source = stream(spark, path)
    writer = settling_writer(["ums_id_"], 60, lambda df, n: released.update(
        {n: sorted(r["ums_id_"] for r in df.collect())}), held_store(source, str(tmp_path / "h")))
    start(source, writer, str(tmp_path / "cp")).awaitTermination()
    assert released == {0: [1], 1: [2]}


FIELDS = [Field("ums_id_", "long"), Field("ums_ts_", "datetime"), Field("ums_op_"),
          Field("k", "long")]


def messages(spark):
    def body(ns, cells):
        fields = ",".join(f'{{"name":"{f.name}","type":"{f.type}"}}' for f in FIELDS)
        return (f"data_increment_data.{ns}", f'{{"protocol":{{"type":"data_increment_data"}},'
                f'"schema":{{"namespace":"{ns}","fields":[{fields}]}},"payload":[{cells}]}}')

    a, b = "s.i.d.a.1.0.0", "s.i.d.b.1.0.0"
    row = '{"tuple":["%s","2024-01-01 00:00:00","i","5"]}'
    return spark.createDataFrame([body(a, row % "1"), body(a, row % "oops"), body(b, row % "2"),
                                  (f"data_increment_data.{b}", "{cut")],
                                 "key string, value string")


def test_many_flows_on_one_batch(spark):
    got, failed, reports = {}, [], []

    def keep(df, sink, batch_id):
        got[sink.name] = sorted(r["ums_id_"] for r in df.collect())

    def broken(df, sink, batch_id):
        raise RuntimeError("no such store")

    flows = [FlowSpec("s.i.d.a.*.*.*", [SqlStep("SELECT *, k * 2 AS kk FROM a")],
                      Sink(broken, "first"), FIELDS, name="fails"),
             FlowSpec("s.i.d.a.*.*.*", [], Sink(keep, "second"), FIELDS),
             FlowSpec("s.i.d.b.*.*.*", [], Sink(keep, "third"), FIELDS)]
    flows_writer(flows, failed=lambda name, n, e: failed.append(name))(messages(spark), 3)
    assert got == {"second": [1], "third": [2]} and failed == ["fails"]
    with pytest.raises(FlowFailure):
        flows_writer(flows[1:2], on_error="interrupt")(messages(spark), 4)
    flows_writer(flows[1:], on_error="feedback", feedback=lambda df, n: reports.extend(
        (r["sink"], r["reason"]) for r in df.collect()))(messages(spark), 5)
    assert sorted(reason for _, reason in reports) == ["cell does not convert",
                                                       "message does not decode"]
    with pytest.raises(ValueError):
        flows_writer([], on_error="what")


def test_gate_without_a_place_for_its_rows_is_refused(spark):
    rows = spark.sql("""SELECT id AS ums_id_, timestamp_seconds(id * 100) AS ums_ts_, id AS k,
                        IF(id = 2, 'x', NULL) AS name FROM range(4)""")
    flow = FlowSpec("s.i.d.a.*.*.*", validity=Validity(["name"], "and", "timeout", -100, "alert"),
                    name="gate")
    with pytest.raises(ValueError, match="gate"):
        flows_writer([flow], held={"other": "x"}, alert=lambda df, n: None)
    with pytest.raises(ValueError, match="gate"):
        run_flow(flow, rows)
    rest = []
    sent = run_flow(flow, rows, lambda df: rest.extend((r.k, r._fate) for r in df.collect()))
    assert [r.k for r in sent.collect()] == [2]
    assert sorted(rest) == [(0, "alert"), (1, "alert"), (3, "hold")]


def test_flow_and_job_entry_points(spark, tmp_path):
    spec = FlowSpec("s.i.d.a.*.*.*", [SqlStep("SELECT *, k + 1 AS n FROM a")],
                    Sink(lambda *a: None, output="n:next"), FIELDS)
    out = run_flow(spec, messages(spark))
    assert out.columns == ["next", "ums_ts_", "ums_id_", "ums_op_"] and out.first()["next"] == 6
    path = str(tmp_path / "out")
    job = JobSpec(decode(messages(spark), spec), steps=[SqlStep("SELECT * FROM increment")],
                  projection="k", path=path)
    run_job(spark, job)
    assert spark.read.parquet(path).columns == ["k", "ums_ts_", "ums_id_", "ums_op_"]


def test_stream_of_changes_equals_snapshot(spark, tmp_path):
    rows = [(i, i, "iud"[i % 3], i % 5, i) for i in range(60)]
    path = write_files(spark, str(tmp_path / "in"), [rows[:20], rows[40:], rows[20:40]])
    versions = str(tmp_path / "table")

    def write(batch, batch_id):
        changes = batch.drop("ums_uid_")
        before = f"{versions}/{batch_id - 1}"
        table = to_target(changes, ["k"]) if batch_id == 0 else \
            apply_changes(spark.read.parquet(before), changes, ["k"])
        table.write.mode("overwrite").parquet(f"{versions}/{batch_id}")

    start(stream(spark, path), write, str(tmp_path / "cp")).awaitTermination()
    got = {r["k"]: r["ums_id_"] for r in spark.read.parquet(f"{versions}/2")
           .filter("ums_active_ = 1").collect()}
    whole = spark.createDataFrame(rows, "ums_id_ long, s long, ums_op_ string, k long, v long") \
        .withColumn("ums_ts_", F.timestamp_seconds("s"))
    assert got == {r["k"]: r["ums_id_"] for r in snapshot(whole, ["k"]).collect()}


def test_settled_stream_equals_settled_table(spark, tmp_path):
    groups = [[(1, 10, "i", 1, 0), (2, 95, "i", 2, 0), (7, 90, "i", 2, 5)],
              [(3, 92, "i", 2, 1), (4, 200, "i", 3, 0), (5, 150, "i", 1, 9)],
              [(6, 260, "i", None, 0), (8, 200, "i", 4, 0)]]
    path = write_files(spark, str(tmp_path / "in"), groups)
    out = drain(settle_stream(stream(spark, path), ["k"], 60)).drop("_batch")
    whole = settle(spark.read.parquet(path), None, ["k"], 60)
    want = whole.filter("_released").drop("_released")
    assert out.columns == want.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
    # 7 at 90 is the earliest of its identity; 5 came while 1 was remembered
    assert {r["ums_id_"] for r in out.collect()} == {1, 7, 4, 8}


def test_idle_keys_are_forgotten(spark, tmp_path):
    path, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    got = []
    for n, idle in enumerate((3600, 3600, 2)):
        write_files(spark, f"{path}-{n}", [[(i, 5, "i", i % 3, 1) for i in range(9)]])
        spark.read.parquet(f"{path}-{n}/*").write.mode("append").parquet(path)
        if idle == 2:
            checkpoint = str(tmp_path / "cp2")
        counts = running_agg(file_stream(spark, path, SCHEMA), ["k"], {"n": ("count", "")},
                             idle_hours=idle / 3600)
        out, _ = run_to_idle(counts, checkpoint, "update")
        got.append({r["k"]: r["n"] for r in out.groupBy("k").agg(F.max("n").alias("n")).collect()})
    assert got[0] == {0: 3, 1: 3, 2: 3} and got[1] == {0: 6, 1: 6, 2: 6}
    time.sleep(3)
    write_files(spark, f"{path}-4", [[(20, 5, "i", 1, 1)]])
    spark.read.parquet(f"{path}-4/*").write.mode("append").parquet(path)
    out, _ = run_to_idle(running_agg(file_stream(spark, path, SCHEMA), ["k"], {"n": ("count", "")},
                                     idle_hours=2 / 3600), checkpoint, "update")
    assert [(r["k"], r["n"]) for r in out.collect()] == [(1, 1)]
