import json

import pytest
from pyspark.sql import functions as F

from changeloom.operators.metrics import merge_ranges
from changeloom.plans.registry import Udaf, aggregate_udaf
from changeloom.sinks.encode import Route, route, to_ums
from changeloom.sinks.shape import to_requests, to_shards
from changeloom.sinks.write import (SINKS, SinkError, register_sink, write_all, write_jdbc,
                                    write_jdbc_split)
from changeloom.sources.messages import read_ums
from changeloom.sources.tables import jdbc_table


@pytest.fixture()
def url(tmp_path):
    # embedded, in this process, no port
    return f"jdbc:derby:{tmp_path}/db;create=true"


SCHEMA = "ums_id_ long, ums_ts_ string, ums_op_ string, k long, v long"


def log(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ums_ts_", F.to_timestamp("ums_ts_"))


def at(i, op, k, v):
    return (i, "2024-01-01 00:00:00", op, k, v)


def rows(spark, url, sql, columns):
    return sorted(tuple(r[c] for c in columns) for r in jdbc_table(spark, url, sql).collect())


def test_relational_sink_is_idempotent(spark, url):
    first = log(spark, [at(1, "i", 1, 10), at(2, "i", 2, 20)])
    write_jdbc(first, url, "t", ["k"], mutation="i")
    more = log(spark, [at(5, "u", 1, 11), at(1, "u", 2, 99), at(6, "d", 3, 30), at(4, "u", 1, 0)])
    for _ in range(2):
        write_jdbc(more, url, "t", ["k"])
    assert rows(spark, url, 'SELECT "k", "v", "ums_active_" FROM t', ["k", "v", "ums_active_"]) == \
        [(1, 11, 1), (2, 20, 1), (3, 30, 0)]
    with pytest.raises(ValueError):
        write_jdbc(more, url, "t", ["k"], mutation="what")


def test_two_table_sink(spark, url):
    spark.createDataFrame([(1, 10), (2, 20)], "k long, v long").write.jdbc(url, "m")
    log(spark, [at(3, "i", 1, 0)]).select("k", "ums_id_", F.lit(1).alias("ums_active_")) \
        .write.jdbc(url, "x")
    changes = log(spark, [at(5, "d", 1, 0), at(6, "u", 2, 21), at(7, "i", 4, 40)])
    for _ in range(2):
        write_jdbc_split(changes, url, "m", "x", ["k"])
    assert rows(spark, url, "SELECT * FROM m", ["k", "v"]) == [(2, 21), (4, 40)]
    assert rows(spark, url, "SELECT * FROM x", ["k", "ums_id_", "ums_active_"]) == \
        [(1, 5, 0), (2, 6, 1), (4, 7, 1)]


def test_relational_scan(spark, url):
    spark.range(100).select(F.col("id").alias("ID"), (F.col("id") % 3).alias("G")) \
        .write.jdbc(url, "s")
    assert jdbc_table(spark, url, 'SELECT "ID" AS NUM, "G" FROM s WHERE "G" = 1').columns == ["num", "g"]
    whole = jdbc_table(spark, url, 'SELECT "ID" AS NUM FROM s', partition_column="NUM",
                       bounds=(0, 100), partitions=4)
    assert whole.count() == 100 and whole.rdd.getNumPartitions() == 4
    parts = jdbc_table(spark, url, 'SELECT "ID" AS NUM FROM s',
                       predicates=["NUM < 50", "NUM >= 50"])
    assert parts.count() == 100


def test_packing(spark):
    df = spark.range(0, 230, numPartitions=2).withColumn("s", F.lit('quote " and \\ and \n'))
    sent = to_ums(df, "a.b.c.d.e.f.g", limit=50)
    assert sorted(r["n"] for r in sent.select(F.expr(
        "json_array_length(get_json_object(value, '$.payload'))").alias("n")).collect()) == \
        [15, 15, 50, 50, 50, 50]
    back = read_ums(sent)
    assert back.select("namespace").distinct().count() == 1
    assert {r["t"] for r in back.select(F.col("tuple")[1].alias("t")).distinct().collect()} == \
        {'quote " and \\ and \n'}
    assert back.count() == 230


def test_route_leaves_other_bodies(spark):
    df = spark.createDataFrame([("data_increment_data.s.i.d.t.1.0.0.5.x", "plain"),
                                ("short.key", "plain"), (None, "plain")],
                               "key string, value string")
    out = route(df, [Route("s.i.d.t.*.*.*", "q.i.d.u", "out")]).collect()
    assert [tuple(r) for r in out] == [("out", "data_increment_data.q.i.d.u.1.0.0.5.x", "plain")]


def test_fan_out_tries_all(spark):
    seen = []

    def bad(df):
        raise RuntimeError("down")

    register_sink("count", lambda df: seen.append(df.count()))
    for parallel in (False, True):
        with pytest.raises(SinkError) as e:
            write_all(spark.range(5), {"bad": bad, "good": SINKS["count"]}, parallel)
        assert set(e.value.failures) == {"bad"}
    assert seen == [5, 5]


def test_shards_take_inserts_only(spark):
    with pytest.raises(ValueError):
        to_shards(spark.range(1), ["id"], 2, mutation="iud")


def test_request_bodies(spark):
    df = spark.createDataFrame([(1, "a b&c", None)], "id long, s string, n string")
    row = to_requests(df, "put", "/x/${id}", "form").first()
    assert tuple(row) == ("PUT", "/x/1", "id=1&s=a+b%26c&n=")
    assert to_requests(df, "get", "/${s}", "none").first()["body"] is None
    assert to_requests(df, "post", "/", "json").first()["body"] == '{"id":1,"s":"a b&c","n":null}'


def test_merged_ranges(spark):
    df = spark.createDataFrame([("t", 0, 1, 5), ("t", 0, 4, 9), ("t", 0, 10, 12), ("t", 0, 20, 21),
                                ("t", 1, 3, 4)],
                               "topic string, partition int, from_offset long, until_offset long")
    assert sorted(tuple(r)[1:] for r in merge_ranges(df).collect()) == \
        [(0, 1, 12), (0, 20, 21), (1, 3, 4)]


def test_user_aggregate_of_one_hot_key(spark):
    class Longest(Udaf):
        return_type = "string"

        def create_accumulator(self):
            return ""

        def accumulate(self, acc, value):
            return value if value is not None and len(value) > len(acc) else acc

        def merge(self, acc, other):
            return self.accumulate(acc, other)

        def get_value(self, acc):
            return acc

    df = spark.range(0, 40_000).select(F.lit(1).alias("k"), F.repeat(F.lit("x"), F.col("id")
                                       .cast("int") % 97).alias("s"))
    assert len(aggregate_udaf(df, ["k"], Longest, ["s"], "top").first()["top"]) == 96
    with pytest.raises(ValueError):
        aggregate_udaf(df, ["k"], Udaf, ["s"], "top")


def test_route_with_blanks_and_tricky_payload(spark):
    body = ('{"protocol": {"type": "data_increment_data"}, "schema" : { "namespace" : '
            '"s.i.d.t.1.0.0", "fields": []}, "payload": [{"tuple": '
            '["\\"namespace\\":\\"s.i.d.t.1.0.0\\"", "$1"]}]}')
    df = spark.createDataFrame([("data_increment_data.s.i.d.t.1.0.0", body)],
                               "key string, value string")
    out = route(df, [Route("s.i.d.t.*.*.*", "q.i.d.u", "out")]).collect()
    assert [r["key"] for r in out] == ["data_increment_data.q.i.d.u.1.0.0"]
    assert out[0]["value"] == body.replace('"s.i.d.t.1.0.0",', '"q.i.d.u.1.0.0",', 1)


def test_csv_archive_of_any_text(spark, tmp_path):
    from changeloom.model import Field
    from changeloom.sources.archive import read_csv_archive, write_csv_archive
    fields = [Field("ums_id_", "long"), Field("ums_ts_", "datetime"), Field("ums_op_"),
              Field("note")]
    texts = ["x\ny", "", None, 'say "hi", twice', "\\", " edge "]
    rows = [[str(n), "2024-01-01 00:00:00.000", "i", t] for n, t in enumerate(texts)]
    message = json.dumps({"protocol": {"type": "data_increment_data"}, "schema": {
        "namespace": "a.b.c.d.1.0.0", "fields": [{"name": f.name, "type": f.type or "string"}
                                                 for f in fields]},
        "payload": [{"tuple": r} for r in rows]})
    write_csv_archive(spark.createDataFrame([(message,)], "value string"), str(tmp_path))
    got = read_csv_archive(spark, str(tmp_path), "a.b.c.d.1.0.0", fields).collect()
    assert [r["note"] for r in sorted(got, key=lambda r: r["ums_id_"])] == texts
