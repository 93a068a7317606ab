import json

import pytest

from changeloom.model import Field, Namespace
from changeloom.sources.ext_json import JsonField, infer_ext_schema, parse_codes, read_ext_json
from changeloom.sources.messages import (apply_ums_schema, classify_messages, malformed, read_ums,
                                         rename_keys)
from changeloom.sources.tables import (parquet_table, read_source, register_source)

FIELDS = [("ums_id_", "long"), ("ums_ts_", "datetime"), ("ums_op_", "string"),
          ("Shelf", "int"), ("colour", "string"), ("grams", "long")]
NAME = "Postgres.north.garden.Seeds.7.p1.t3"


def message(rows, namespace=NAME):
    return json.dumps({"protocol": {"type": "data_increment_data"}, "schema": {
        "namespace": namespace,
        "fields": [{"name": n, "type": t} for n, t in FIELDS]},
        "payload": [{"tuple": r} for r in rows]})


ROWS = [["501", "2023-02-03 04:05:06.789012", "i", "8", "red", "1200"],
        ["502", "2023-02-03 04:06:00.250000", "u", "9", None, "70"],
        ["503", "2023-02-04 00:00:00.000001", "d", "10", "dark blue", "3"]]


def frame(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_envelope(spark):
    out = read_ums(frame(spark, message(ROWS), message([]), "not json", '{"payload": null}'))
    rows = out.collect()
    assert len(rows) == 3
    assert rows[0]["namespace"] == NAME.lower()
    assert [f["name"] for f in rows[0]["fields"]][3] == "shelf"
    assert rows[0]["fields"][0]["nullable"] is False
    assert rows[1]["tuple"][4] is None


def test_typed_rows_and_bad_rows(spark):
    fields = [Field("ums_id_", "long"), Field("ums_ts_", "datetime"), Field("shelf", "int"),
              Field("colour"), Field("grams", "long"), Field("absent", "int")]
    bad = ["x", *ROWS[0][1:]]
    df = read_ums(frame(spark, message([*ROWS, bad])))
    good = apply_ums_schema(df, fields).collect()
    assert [r["ums_id_"] for r in good] == [501, 502, 503]
    assert good[0]["ums_ts_"].microsecond == 789000
    assert good[0]["absent"] is None and good[1]["colour"] is None
    only = apply_ums_schema(df, fields, bad="only").collect()
    assert len(only) == 1 and only[0]["tuple"][0] == "x"
    assert apply_ums_schema(df, fields, bad="flag").filter("_bad").count() == 1


def test_malformed(spark):
    df = frame(spark, message(ROWS), message(ROWS)[:30], "[]")
    assert malformed(df).count() == 2


def test_key_classes(spark):
    rows = [("DATA_increment_data.A.b.c.d.1.0.0.123.wh", "{}"), ("data_initial_data.a.b", "{}"),
            (None, "{}"), (" ", message(ROWS)), ("nonsense.a.b.c.d.1.0.0", "{}"), ("", "{}")]
    out = [tuple(r) for r in classify_messages(spark.createDataFrame(rows, "key string, value string"))
           .select("protocol", "namespace").collect()]
    assert out == [("data_increment_data", "a.b.c.d.1.0.0"), ("data_initial_data", ""),
                   ("data_increment_heartbeat", ""),
                   ("data_increment_data", NAME.lower()),
                   ("data_increment_heartbeat", ""), ("data_increment_data", None)]


def test_rename_precedence(spark):
    df = spark.createDataFrame([("k", "t1"), ("k", "t2"), ("x", "t2")], "key string, topic string")
    keys = [r["key"] for r in rename_keys(df, by_topic={"t1": "by-topic"}, by_topic_key={
        ("t2", "k"): "by-key", ("t1", "k"): "never"}).collect()]
    assert keys == ["by-topic", "by-key", "x"]
    assert {r["key"] for r in rename_keys(df, default_key="d").collect()} == {"d"}


def test_extended_json_with_renames(spark):
    fields = [JsonField("seen", "datetime"), JsonField("seen", "datetime", rename="ums_ts_"),
              JsonField("serial", "long"), JsonField("serial", "long", rename="ums_id_"),
              JsonField("kind", codes=parse_codes("i:new,u:moved,d:gone"), rename="ums_op_"),
              JsonField("shelf"),
              JsonField("spot", "jsonobject", (JsonField("row", rename="spot_row"),))]
    # fixed value: the layout of a day and a time without a blank between them
    good = {"seen": "2021-07-0908:07:06", "serial": 41, "kind": "moved", "shelf": "s",
            "spot": {"row": "r2"}}
    bare = {k: v for k, v in good.items() if k != "spot"}
    odd = {**good, "kind": "unheard of"}
    df = frame(spark, *[json.dumps(m) for m in (good, bare, odd)], "{broken")
    rows = read_ext_json(df, "value", fields).collect()
    assert len(rows) == 2
    assert rows[0]["ums_op_"] == "u" and rows[0]["ums_id_"] == 41 and rows[0]["serial"] == 41
    assert str(rows[0]["ums_ts_"]) == "2021-07-09 08:07:06"
    assert [r["spot_row"] for r in rows] == ["r2", None]
    assert read_ext_json(df, "value", fields, bad="only").count() == 2


def test_extended_json_arrays(spark):
    df = frame(spark, '{"id":1,"a":[1,2]}', '{"id":2}', '{"id":3,"a":[]}', '{"id":4,"a":["x"]}')
    fields = [JsonField("id", "int"), JsonField("a", "intarray")]
    assert [tuple(r) for r in read_ext_json(df, "value", fields).collect()] == \
        [(1, 1), (1, 2), (2, None)]
    objects = frame(spark, '{"id":1,"a":[{"b":{"c":5}},{}]}', '{"id":2}', '{"id":3,"a":[]}')
    fields = [JsonField("id", "int"), JsonField("a", "jsonarray", (
        JsonField("b", "jsonobject", (JsonField("c", "int"),)),))]
    assert [tuple(r) for r in read_ext_json(objects, "value", fields).collect()] == \
        [(1, 5), (1, None)]
    assert read_ext_json(objects, "value", fields, bad="only").count() == 1
    with pytest.raises(ValueError):
        read_ext_json(df, "value", [JsonField("a", "intarray"), JsonField("b", "intarray")])


def test_extended_json_tuple(spark):
    df = frame(spark, '{"p":"a|1"}', '{"p":"a"}', '{}')
    fields = [JsonField("p", "tuple", (JsonField("l"), JsonField("r", "int")), "|")]
    assert [tuple(r) for r in read_ext_json(df, "value", fields).collect()] == \
        [("a", 1), (None, None)]


def test_infer_schema(spark):
    df = frame(spark, '{"id":1,"o":{"x":1.5}}', '{"id":2,"l":["a"],"r":[{"y":true}]}')
    found = {f.name: f for f in infer_ext_schema(df, "value")}
    assert found["id"].type == "long" and found["o"].fields[0].type == "double"
    assert found["l"].type == "stringarray" and found["r"].type == "jsonarray"
    assert found["r"].fields[0].type == "boolean"


def test_sources(spark, tmp_path):
    register_source("numbers", lambda s, start, end, ns, conn, options: s.range(options["n"]))
    assert read_source(spark, "numbers", options={"n": 5}).count() == 5
    assert parquet_table(spark, "nothing_there", str(tmp_path / "none")) is None
    with pytest.raises(ValueError):
        read_source(spark, "unknown")


def test_namespace():
    ns = Namespace.parse("A.b.c.d")
    assert str(ns) == "a.b.c.d.*.*.*"
    with pytest.raises(ValueError):
        Namespace.parse("a.b")
