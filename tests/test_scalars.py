import pytest
from pyspark.sql import functions as F

from changeloom.functions.casts import convert_property, decimal_text, scale_number
from changeloom.functions.hashes import murmur3_utf16, scala_string_hash, shard_of, xx_hash64
from changeloom.functions.text import build_key, decrypt_col, padded_hash_mod, sub
from changeloom.functions.times import (dated_name, day_id, month_id, normalize_ts, parse_ts,
                                        ts_not_before, week_id)


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(col).first()[0]


@pytest.mark.parametrize("text", ["", "a", "ab", "abc", "key_1", "ключ", "日本語", "😀x"])
def test_string_hash_equals_the_jvm(spark, text):
    jvm = getattr(getattr(spark._jvm.scala.util.hashing, "MurmurHash3$"), "MODULE$")
    assert murmur3_utf16(text) == jvm.stringHash(text)
    assert one(spark, scala_string_hash(F.col("s")), s=text) == murmur3_utf16(text)


def test_shard(spark):
    df = spark.createDataFrame([("",), ("a",)], "k string")
    # published vector: xxh64 of the empty text with seed 0
    assert df.select(shard_of(["k"], 1000, native=False)).first()[0] == 0xEF46DB3751D8E999 % 1000


def test_padded_hash_mod(spark):
    want = abs(murmur3_utf16("abc")) % 7
    assert one(spark, padded_hash_mod("s", 7, 3), s="abc") == f"{want:03d}"
    assert one(spark, padded_hash_mod("s", 100000, 2), s="abc") == \
        str(abs(murmur3_utf16("abc")) % 100000)[:2]


def test_key_expression(spark):
    assert one(spark, build_key("md5(value(a)) + '_' + sub(b, -2) + prefix(a, 'p')"),
               a="x", b="12345") == "9dd4e461268c8034f5c8564e155c67a6_45px"
    df = spark.createDataFrame([(None, 3)], "a string, b long")
    assert df.select(build_key("a + '|' + hash(b)")).first()[0] == f"N/A|{murmur3_utf16('3')}"
    with pytest.raises(ValueError):
        build_key("__import__('os')")


def test_sub_short(spark):
    assert one(spark, sub("s", 5), s="abc") == "abc"
    assert one(spark, sub("s", -2), s="abc") == "bc"


@pytest.mark.parametrize("text,want", [
    ("2024-01-02", "2024-01-02 00:00:00"), ("20240102 03:04:05.6", "2024-01-02 03:04:05.006000"),
    ("2024/01/02 03:04", "2024-01-02 03:04:00"), ("20240102030405678", "2024-01-02 03:04:05.678000"),
    ("2024-01-02T03:04:05.12", "2024-01-02 03:04:05.012000"), ("nope", None), ("", None),
    ("2024-13-02", None), ("2024-01-02 03:04:05.678999", "2024-01-02 03:04:05.678000"),
    ("2024-01-02 03:04:05Z", "2024-01-02 03:04:05")])
def test_parse(spark, text, want):
    got = one(spark, parse_ts("s"), s=text)
    assert (str(got) if got else None) == want


def test_normalize(spark):
    assert one(spark, normalize_ts("s"), s="123") is None
    assert str(one(spark, normalize_ts("s"), s="1704067200")) == "2024-01-01 00:00:00"


@pytest.mark.parametrize("ts,day,week,month", [
    ("1970-01-01 00:00:00", 0, 0, 0), ("1970-01-05 00:00:00", 4, 1, 0),
    ("1970-02-01 00:00:00", 31, 4, 1), ("1969-12-31 12:00:00", -1, 0, -1),
    ("1969-12-28 00:00:00", -5, -1, -1), ("2024-02-29 23:59:59", 19782, 2826, 649)])
def test_ordinals(spark, ts, day, week, month):
    t = F.to_timestamp(F.lit(ts))
    assert spark.range(1).select(day_id(t), week_id(t), month_id(t)).first()[:] == (day, week, month)


def test_dated_name(spark):
    assert one(spark, dated_name("idx_", "date_nod", F.to_date(F.lit("2024-05-06")))) == "idx_20240506"
    today = one(spark, F.date_format(F.current_date(), "yyyyMMdd"))
    assert one(spark, dated_name("idx_")) == f"idx_{today}"


def test_property(spark):
    assert one(spark, convert_property("v", "number"), v="18.43") == 18430
    assert one(spark, convert_property("v", "bool"), v="5") == 1
    assert one(spark, convert_property("v", "list"), v="plain") == "plain"
    assert one(spark, convert_property("v", "datetime"), v="bad") == 0
    assert one(spark, scale_number("v"), v=0.29) == 290


def test_decimal_text(spark):
    assert one(spark, decimal_text(F.lit("0.0000001000"))) == "0.0000001"
    assert one(spark, decimal_text(F.lit("100"))) == "100"
    assert one(spark, decimal_text(F.lit("10.500"))) == "10.5"


def test_decrypt(spark):
    key = "abcdefghijklmnop"
    sealed = F.hex(F.aes_encrypt(F.lit("id-1"), F.lit(key), F.lit("ECB")))
    assert one(spark, decrypt_col(sealed, key)) == "id-1"
    assert one(spark, decrypt_col(F.lit("zz"), key)) is None


@pytest.mark.parametrize("a,b,want", [("20240102", "", True), ("20240102", "20240102", True),
                                      ("2024010203", "20240102", True),
                                      ("20240102", "2024010203", False),
                                      ("20240103", "2024010203", True)])
def test_not_before(spark, a, b, want):
    assert one(spark, ts_not_before("a", "b"), a=a, b=b) is want


def test_xx_hash_of_all_lengths_and_seeds(spark):
    xxhash = pytest.importorskip("xxhash")
    texts = ["".join(chr(33 + (i * 7 + n) % 90) for i in range(n)) for n in range(0, 140)] + [
        "é漢字🙂" * 9, "\x00", "\x7f" * 33]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "s string")
    for seed in (0, 42, (1 << 64) - 3):
        got = [r[0] for r in df.select(xx_hash64(F.col("s"), seed)).collect()]
        want = [xxhash.xxh64_intdigest(t.encode(), seed=seed) for t in texts]
        assert got == [w - (1 << 64) if w >= 1 << 63 else w for w in want] + [None]
    for n in (1, 7, 1000, 2 ** 31 - 1):
        got = [r[0] for r in df.where("s is not null").select(shard_of(["s"], n, native=False)).collect()]
        assert got == [xxhash.xxh64_intdigest(t.encode(), seed=0) % n for t in texts]
