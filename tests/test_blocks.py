"""Long keys give the same rows as short ones, null times and null values included."""
import datetime as dt

import pytest
from changeloom.operators.blocks import over_range, over_rows, running_sums, running_total
from changeloom.operators.changes import apply_changes
from pyspark.sql import functions as F

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    data = [("k" if n % 3 else None, n, None if n % 5 == 0 else START + dt.timedelta(seconds=n * 7),
             None if n % 4 == 0 or n < 12 else n) for n in range(60)]
    return spark.createDataFrame(data, "k string, id long, at timestamp, v long")


def sorted_rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_blocks_keep_every_row(rows):
    def answers(size):
        return [sorted_rows(f) for f in (
            over_rows(rows, ["k"], ["at", "id"], 2, {"n": F.count("v"), "s": F.sum("v")}, size),
            running_total(rows, ["k"], ["at", "id"], "v", "total", size),
            over_range(rows, ["k"], "at", 30, {"n": F.count("v"), "s": F.sum("v")}, size))]
    whole, cut = answers(1000), answers(8)
    assert [len(a) for a in cut] == [60, 60, 60] and cut == whole


def test_long_frames_over_many_blocks(spark):
    """Frames over many blocks of a key, and over all rows without one: counts, sums, extremes."""
    import random
    rng = random.Random(5)
    data, second = [], 0
    for n in range(200):
        second += rng.choice([0, 0, 1, 3, 40])
        data.append((rng.choice("aaab"), n, START + dt.timedelta(seconds=second),
                     rng.choice([None, rng.randrange(100)])))
    rows = spark.createDataFrame(data, "k string, id long, at timestamp, v long")
    aggs = {"n": F.count(F.lit(1)), "s": F.sum("v"), "low": F.min("v"), "top": F.max("v")}
    for keys in (["k"], []):
        got = sorted_rows(over_range(rows, keys, "at", 600, aggs, 9))
        want = []
        for k, i, at, v in data:
            seen = [x[3] for x in data if (not keys or x[0] == k)
                    and at - dt.timedelta(seconds=600) <= x[2] <= at]
            some = [x for x in seen if x is not None]
            want.append((k, i, at, v, len(seen), sum(some) if some else None,
                         min(some, default=None), max(some, default=None)))
        assert got == sorted(want, key=repr)


@pytest.mark.parametrize("size", [3, 9, 1000])
def test_sums_and_totals_of_long_keys(rows, size):
    data = [tuple(r) for r in rows.collect()]
    got = running_sums(rows.withColumn("one", F.lit(1)), ["k"], ["at", "id"],
                       {"n": "one", "s": "v"}, size, {"all": "v", "rows": "one"})
    want = []
    for k in {r[0] for r in data}:
        mine = sorted((r for r in data if r[0] == k), key=lambda r: (r[2] is not None, r[2] or 0, r[1]))
        values = [r[3] for r in mine]
        total = [v for v in values if v is not None]
        for n, r in enumerate(mine):
            seen = [v for v in values[:n + 1] if v is not None]
            want.append((*r, 1, n + 1, sum(seen) if seen else None,
                         sum(total) if total else None, len(mine)))
    assert sorted_rows(got) == sorted(want, key=repr)


def test_split_takes_one_scan_and_no_join(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    for frame, most in (
            (over_rows(events, ["user_id"], ["ts", "event_id"], 3, {"s": F.sum("value")}, 50), 1),
            (running_total(events, [], ["ts", "event_id"], "value", "t", 50), 1),
            (over_range(events, ["event_type"], "ts", 999_999, {"s": F.max("value")}, 50), 2)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == plan.count("Exchange hash") == most
        assert "Join" not in plan


def test_a_stored_row_without_version_is_replaced(spark):
    schema = "k long, ums_id_ long, ums_ts_ timestamp, {} , v string"
    stored = spark.createDataFrame([(1, None, START, 1, "old"), (2, None, START, 1, "stays")],
                                   schema.format("ums_active_ int"))
    new = spark.createDataFrame([(1, 5, START, "u", "new")], schema.format("ums_op_ string"))
    got = {r["k"]: r["v"] for r in apply_changes(stored, new, ["k"]).collect()}
    assert got == {1: "new", 2: "stays"}


def test_versioned_table_rewrites_only_touched_buckets(spark, tmp_path):
    from changeloom.sinks.versions import VersionedTable
    schema = "k long, ums_id_ long, ums_ts_ timestamp, ums_op_ string, v string"
    store = VersionedTable(spark, str(tmp_path / "table"), ["k"], buckets=8)
    store.upsert(spark.createDataFrame([(k, 1, START, "i", "a") for k in range(40)], schema), 0)
    new = spark.createDataFrame([(3, 2, START, "u", "b"), (99, 2, START, "i", "c")], schema)
    for _ in range(2):
        store.upsert(new, 1)
    got = {r["k"]: r["v"] for r in store.read().collect()}
    assert got == {**{k: "a" for k in range(40)}, 3: "b", 99: "c"}
    assert {r["k"]: r["v"] for r in store.read(0).collect()} == {k: "a" for k in range(40)}
    versions = list(store._pointer(1).values())
    assert 0 < versions.count(1) <= 2 and versions.count(0) >= 6
