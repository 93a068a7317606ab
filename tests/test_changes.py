import random

import pytest
from pyspark.sql import functions as F

from changeloom.operators.blocks import over_rows, sequence_blocks
from changeloom.operators.changes import (apply_changes, apply_split, merge_latest, plan_upsert,
                                          snapshot, to_target)
from changeloom.operators.lookups import lookup, pair_before_after
from changeloom.operators.sets import union_lookup

SCHEMA = "ums_id_ long, ums_ts_ timestamp, ums_op_ string, k long, v string"


def log(spark, rows):
    return spark.createDataFrame(rows, "ums_id_ long, t string, ums_op_ string, k long, v string") \
        .select("ums_id_", F.to_timestamp("t").alias("ums_ts_"), "ums_op_", "k", "v")


def row(i, op, k, v="x"):
    return (i, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", op, k, v)


def test_delete_then_insert_and_nulls(spark):
    df = log(spark, [row(1, "i", 1), row(2, "d", 1), row(3, "u", 1, "new"), row(4, "d", 2),
                     row(5, "b", 3), row(6, "i", None), row(7, "u", None)])
    latest = {r["k"]: (r["ums_id_"], r["ums_op_"]) for r in merge_latest(df, ["k"]).collect()}
    assert latest == {1: (3, "u"), 2: (4, "d"), None: (7, "u")}
    assert {r["k"] for r in snapshot(df.filter("ums_op_ <> 'b'"), ["k"]).collect()} == {1, None}


def test_ties_are_settled_the_same_way(spark):
    rows = [(1, "2024-01-01 00:00:00", "i", 1, v) for v in "abcdef"]
    winners = set()
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        winners.add(merge_latest(log(spark, rows).repartition(3), ["k"]).first()["v"])
    assert len(winners) == 1


def test_random_splits_give_the_snapshot(spark, tmp_path):
    rng = random.Random(5)
    rows = [row(i, rng.choice("iud"), rng.randrange(12), str(i)) for i in range(200)]
    want = {r["k"]: (r["ums_id_"], r["v"], r["ums_active_"])
            for r in to_target(log(spark, rows), ["k"]).collect()}
    rng.shuffle(rows)
    table = to_target(log(spark, rows[:1]).limit(0), ["k"])
    for n, cut in enumerate(range(0, 200, 67)):
        part = rows[cut:cut + 67] + rng.sample(rows[:cut + 67], 10)   # with some replays
        table = apply_changes(table, log(spark, part), ["k"])
        path = str(tmp_path / f"v{n}")
        table.write.parquet(path)       # a new version folder, never the one being read
        table = spark.read.parquet(path)
    got = {r["k"]: (r["ums_id_"], r["v"], r["ums_active_"]) for r in table.collect()}
    assert got == want


def test_upsert_plan_with_null_version(spark):
    target = spark.createDataFrame([(1, None), (2, 9)], "k long, ums_id_ long")
    df = log(spark, [row(5, "i", 1), row(5, "i", 2), row(5, "i", 3)])
    plan = {r["k"]: r["action"] for r in plan_upsert(df, target, ["k"]).collect()}
    assert plan == {1: "skip", 2: "skip", 3: "i"}
    plan = {r["k"]: r["action"] for r in plan_upsert(df, target, ["k"], True).collect()}
    assert plan[1] == "u"


def test_split_tables_delete_in_the_master(spark):
    master = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    meta = spark.createDataFrame([(1, 5, 1), (3, 9, 0)], "k long, ums_id_ long, ums_active_ int")
    df = log(spark, [row(7, "d", 1), row(7, "u", 2, "c"), row(7, "i", 3), row(7, "d", 4)])
    new_master, new_meta = apply_split(df, master, meta, ["k"])
    assert sorted(map(tuple, new_master.collect())) == [(2, "c")]
    assert sorted(map(tuple, new_meta.collect())) == [(1, 7, 0), (2, 7, 1), (3, 9, 0), (4, 7, 0)]


def test_unknown_mutation(spark):
    with pytest.raises(ValueError):
        apply_changes(spark.range(1), spark.range(1), ["id"], "what")


def test_pairing_drops_unpaired_updates(spark):
    df = log(spark, [row(1, "i", 1), row(2, "u", 1, "after"), row(2, "b", 1, "before"),
                     row(3, "u", 1), row(4, "d", 1)])
    got = {r["ums_id_"]: r["ums_b_v"] for r in pair_before_after(df).collect()}
    assert got == {1: None, 2: "before", 4: None}


def test_empty_lookups(spark):
    df = log(spark, [row(1, "i", 1), row(2, "i", None)])
    empty = spark.createDataFrame([], "key long, name string")
    assert lookup(df, empty, [("k", "key")], "left").filter("name is null").count() == 2
    assert lookup(df, empty, [("k", "key")]).count() == 0
    assert lookup(df, empty, [], "left", columns=["name"]).count() == 2
    assert union_lookup(df, empty.withColumnRenamed("key", "k"), [("k", "k")]).count() == 2


def test_keyless_lookup_refuses_large_tables(spark):
    with pytest.raises(ValueError):
        lookup(spark.range(2), spark.range(20_000).withColumnRenamed("id", "x"), [])


@pytest.mark.parametrize("block_rows", [7, 20, 10_000])
def test_blocks_cover_each_row_once(spark, block_rows):
    rng = random.Random(3)
    rows = [row(i, "i", rng.choice([1, 1, 1, 1, 2, None])) for i in range(300)]
    df = log(spark, rows)
    b = sequence_blocks(df, ["k"], ["ums_ts_", "ums_id_"], before=2, after=3,
                        block_rows=block_rows)
    own = b.df.filter("_own")
    assert sorted(r["ums_id_"] for r in own.collect()) == list(range(300))
    sizes = [r["count"] for r in own.groupBy("k", "_block").count().collect()]
    assert max(sizes) <= block_rows
    t = sequence_blocks(df, ["k"], ["ums_ts_", "ums_id_"], after_seconds=15, block_rows=block_rows)
    assert sorted(r["ums_id_"] for r in t.df.filter("_own").collect()) == list(range(300))


def test_one_key_holds_everything(spark):
    df = log(spark, [row(i, "i", 1) for i in range(500)])
    out = over_rows(df, ["k"], ["ums_ts_", "ums_id_"], 2, {"s": F.sum("ums_id_")}, block_rows=50)
    got = {r["ums_id_"]: r["s"] for r in out.collect()}
    assert got == {i: sum(range(max(0, i - 2), i + 1)) for i in range(500)}
