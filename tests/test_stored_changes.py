"""Stored tables of changes: layouts that the planner knows, splits, tries of a batch."""
import datetime as dt

from pyspark.sql import functions as F

from changeloom.sinks.bucketed import BucketedTable, partitions
from changeloom.sinks.versions import VersionedTable

START = dt.datetime(2024, 1, 1)
SCHEMA = "k long, ums_id_ long, ums_ts_ timestamp, ums_op_ string, v string"


def loaded(spark, table, n=100):
    table.upsert(spark.createDataFrame([(k, 1, START, "i", "a") for k in range(n)], SCHEMA), 0)
    return table


def values(frame):
    return {r["k"]: r["v"] for r in frame.collect()}


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_bucketed_upsert_moves_only_the_batch(spark, tmp_path):
    table = loaded(spark, BucketedTable(spark, str(tmp_path / "t'1"), ["k"], buckets=8))
    new = spark.createDataFrame([(3, 2, START, "u", "b"), (999, 2, START, "i", "c")], SCHEMA)
    with partitions(spark, 8):
        text = plan(table.after(new, table.layout(0, spark)))
    assert text.count("Exchange") == 1 and "Bucketed: true" in text
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    table.upsert(new, 1)
    assert values(table.read()) == {**{k: "a" for k in range(100)}, 3: "b", 999: "c"}
    assert values(table.read(0)) == {k: "a" for k in range(100)}


def test_buckets_split_without_a_shuffle(spark, tmp_path):
    table = loaded(spark, BucketedTable(spark, str(tmp_path / "t"), ["k"], buckets=2,
                                        bucket_rows=20))
    for batch in (1, 2):
        new = spark.createDataFrame([(batch, batch + 1, START, "d", None)], SCHEMA)
        table.upsert(new, batch)
    assert [table.layout(n, spark).buckets for n in (0, 1, 2)] == [2, 8, 8]
    # a file holds one bucket, and the keys that hash to it
    rows = table.read().select("k", F.input_file_name().alias("f"),
                               F.expr("pmod(hash(k), 8)").alias("b"))
    assert rows.select((F.regexp_extract("f", r"_(\d{5})\.c", 1).cast("int") == F.col("b"))
                       .alias("ok")).distinct().collect() == [(True,)]
    dead = {r["k"] for r in table.read().filter("ums_active_ = 0").collect()}
    assert dead == {1, 2} and table.read().count() == 100


def test_a_try_leaves_readers_of_an_earlier_try_alone(spark, tmp_path):
    new = spark.createDataFrame([(3, 2, START, "u", "b")], SCHEMA)
    for table in (BucketedTable(spark, str(tmp_path / "a"), ["k"], buckets=4),
                  VersionedTable(spark, str(tmp_path / "b"), ["k"], buckets=4)):
        loaded(spark, table, 10)
        table.upsert(new, 1)
        reader = table.read()
        files = set(reader.inputFiles())
        table.upsert(new, 1)
        want = {**{k: "a" for k in range(10)}, 3: "b"}
        assert values(reader) == want and set(reader.inputFiles()) == files
        assert values(table.read()) == want
        table.upsert(spark.createDataFrame([(3, 1, START, "u", "old")], SCHEMA), 2)
        table.upsert(spark.createDataFrame([], SCHEMA), 3)
        assert values(table.read()) == want
