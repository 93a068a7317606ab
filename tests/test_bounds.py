"""What the driver, the state store and a batch hold does not grow with keys or small blocks."""
import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from changeloom.functions.times import parse_ts
from changeloom.operators import blocks
from changeloom.operators.blocks import Ranges, over_rows, running_total
from changeloom.operators.lookups import stream_join
from changeloom.patterns import Output, PatternSpec, Stage, match_pattern
from changeloom.plans import registry
from changeloom.plans.registry import Udaf
from changeloom.sinks import bucketed
from changeloom.sinks.bucketed import BucketedTable
from changeloom.sources.streams import file_stream
from changeloom.streaming import state
from changeloom.streaming.hold import settle_stream
from changeloom.streaming.run import drain
from changeloom.streaming.state import match_pattern_stream

START = dt.datetime(2024, 1, 1)


def seconds(col):
    return F.timestamp_seconds(F.lit(1_704_067_200) + F.col(col))


def test_hot_rows_are_marked_without_a_forced_broadcast(spark):
    rows = spark.range(400).select("id", (F.col("id") % 40).alias("k"), seconds("id").alias("ums_ts_"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = stream_join(rows, rows, [("k", "k")], 50, "left", columns={"id": "other"}, hot_rows=1)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        got = {(r["id"], r["other"]) for r in joined.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" not in plan
    assert got == {(i, j) for i in range(400) for j in (i - 40, i, i + 40) if 0 <= j < 400}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_copies_of_right_rows_are_not_broadcast(spark, how):
    rows = spark.range(400).select("id", (F.col("id") % 40).alias("k"), seconds("id").alias("ums_ts_"))
    rows = rows.union(spark.sql("SELECT 400L, CAST(NULL AS BIGINT), TIMESTAMP '2024-01-01'"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        joined = stream_join(rows, rows, [("k", "k")], 50, how, columns={"id": "other"}, hot_rows=1)
        got = sorted(((r["id"], r["other"]) for r in joined.collect()), key=str)
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    meets = [line for line in plan.splitlines() if "Join" in line and "_rsalt" in line]
    assert meets and all("SortMergeJoin" in line for line in meets)
    want = [(i, j) for i in range(400) for j in (i - 40, i, i + 40) if 0 <= j < 400]
    assert got == sorted(want + [(400, None)] * (how == "left"), key=str)


@pytest.fixture
def few_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "MAX_BLOCKS", 7)


def test_cuts_are_bounded_however_small_the_blocks(spark, few_blocks):
    rows = spark.range(600).select("id", (F.col("id") % 3).alias("k"), F.when(
        F.col("id") % 4 != 0, F.col("id")).alias("v"))
    assert len(Ranges(rows, ["k"], ["id"], 2).cuts) == 6
    got = {r["id"]: (r["n"], r["total"]) for r in over_rows(
        running_total(rows, ["k"], ["id"], "v", "total", block_rows=2), ["k"], ["id"], 2,
        {"n": F.count("v")}, block_rows=3).collect()}
    for i in range(600):
        own = [j for j in range(i % 3, i + 1, 3)]
        assert got[i] == (sum(j % 4 != 0 for j in own[-3:]),
                          sum(j for j in own if j % 4) if any(j % 4 for j in own) else None)


@pytest.mark.parametrize("kind", ["next", "followedby"])
def test_patterns_over_bounded_cuts(spark, few_blocks, kind):
    rows = spark.range(300).select(
        F.col("id").alias("ums_id_"), seconds("id").alias("ums_ts_"), (F.col("id") % 2).alias("k"),
        F.substring(F.lit("abcab"), (F.col("id") % 5).cast("int") + 1, F.lit(1)).alias("v"))
    for within in (-1, 5):
        spec = PatternSpec((Stage("begin", "v = 'a'"), Stage(kind, "v = 'c'")), ("k",),
                           within_seconds=within, output=Output("detail"))
        cut = match_pattern(rows, spec, block_rows=3).collect()
        assert cut and sorted(cut) == sorted(match_pattern(rows, spec).collect())


def held(spark, path, variable):
    return spark.read.format("statestore").option("path", path).option(
        "stateVarName", variable).load().count()


KEYS = "k long, d double, t timestamp, ums_id_ long"


def many_keys(spark, tmp_path, n=60):
    """Null and long keys, two zeros."""
    rows = [(None if k == 0 else 2 ** 53 + k, (-0.0, 0.0)[i], START + dt.timedelta(seconds=5 - i), 10 * k + i)
            for k in range(n) for i in (0, 1)]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, KEYS).coalesce(1).write.parquet(path)
    return file_stream(spark, path, spark.read.parquet(path).schema)


def test_settling_state_is_kept_by_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "PARTS", 8, raising=False)
    rows, checkpoint = many_keys(spark, tmp_path), str(tmp_path / "checkpoint")
    assert drain(settle_stream(rows, ["k", "d"], 60, "t"), checkpoint=checkpoint).count() == 0
    assert 0 < held(spark, checkpoint, "held") <= 8
    out = drain(settle_stream(rows, ["k", "d"], 0, "t"))
    assert {(r["k"], r["ums_id_"]) for r in out.collect()} == {
        (None if k == 0 else 2 ** 53 + k, 10 * k + 1) for k in range(60)}


def test_pattern_state_is_kept_by_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "PARTS", 8, raising=False)
    rows = many_keys(spark, tmp_path).union(many_keys(spark, tmp_path / "b")).withWatermark("t", "0 seconds")
    spec = PatternSpec((Stage("begin", "ums_id_ % 10 = 1"), Stage("next", "ums_id_ % 10 = 1")), ("k",),
                       output=Output("detail"))
    checkpoint = str(tmp_path / "checkpoint")
    out = drain(match_pattern_stream(rows, spec, ["t", "ums_id_"]), checkpoint=checkpoint)
    # rows at 4 s are behind the watermark of 5 s: both are matched, twice the events of a key
    assert sorted((r["k"] or 0, r["ums_id_"]) for r in out.collect()) == sorted(
        (k and 2 ** 53 + k, 10 * k + 1) for k in range(60) for _ in (0, 1))
    assert 0 < held(spark, checkpoint, "waiting") <= 8


def test_buckets_stop_splitting(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bucketed, "MAX_BUCKETS", 8, raising=False)
    table = BucketedTable(spark, str(tmp_path / "t"), ["k"], buckets=2, bucket_rows=3)
    schema = "k long, ums_id_ long, ums_ts_ timestamp, ums_op_ string, v string"
    for batch in range(3):
        table.upsert(spark.createDataFrame([(k, batch + 1, START, "i", str(batch)) for k in
                                            range(batch, 100)], schema), batch)
    assert [table.layout(n, spark).buckets for n in range(3)] == [2, 8, 8]
    assert {r["k"]: r["v"] for r in table.read().collect()} == {
        k: str(min(k, 2)) for k in range(100)}


def test_layout_steps_run_where_they_are_needed(spark):
    """Texts at the edges of the shortcuts; full digits go by a cast."""
    texts = {"2024-02-30": None, "2024-01-01 24:00:00": None, "on 2024": None,
             "2024-01-01\n": None, "2024-01-01 10:00:00.12\n": None, "\t2024-01-01": None,
             "2024-1-1": None, "2024-01-01 10:00:00.1+08:00": None, "epoch": None, "": None,
             "2024-01-01 10": START.replace(hour=10), "20240101": START, "2024/01/01 Z": START,
             "2024/01/01 10:00:00.12": START.replace(hour=10, microsecond=12_000),
             "2024-01-01 10:00:00.123456789Z": START.replace(hour=10, microsecond=123_000)}
    frame = spark.createDataFrame([(t,) for t in texts], "s string")
    parsed = frame.select("s", parse_ts("s").cast("timestamp_ntz").alias("t"))
    assert {r["s"]: r["t"] for r in parsed.collect()} == texts
    assert "try_cast" in parsed._jdf.queryExecution().optimizedPlan().toString().lower()


def test_registered_aggregate_reads_slices(spark, monkeypatch):
    class Spy(Udaf):
        """Rows and sum in one number."""

        return_type = "long"

        def create_accumulator(self):
            return (0, 0)

        def accumulate(self, acc, value):
            return (acc[0] + 1, acc[1] + value)

        def get_value(self, acc):
            return acc[0] * 1_000_000 + acc[1]

    monkeypatch.setattr(registry, "SLICE_ROWS", 7, raising=False)
    registry.register_udaf(spark, "spy_udaf", Spy)
    spark.range(100).selectExpr("id % 3 AS g", "id").createOrReplaceTempView("spied")
    got = spark.sql("SELECT g, spy_udaf(id) AS n FROM spied GROUP BY g").collect()
    assert {r["g"]: r["n"] for r in got} == {
        g: len(range(g, 100, 3)) * 1_000_000 + sum(range(g, 100, 3)) for g in range(3)}

    class Lazy(pd.Series):
        sizes: list = []

        @property
        def _constructor(self):
            return Lazy

        def tolist(self):
            Lazy.sizes.append(len(self))
            return super().tolist()
    run = registry.register_udaf(spark, "spy_udaf", Spy).func
    assert run(Lazy(range(20))) == 20_000_190 and max(Lazy.sizes) == 7
