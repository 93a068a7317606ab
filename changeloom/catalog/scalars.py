"""Scalar functions: STR-*, DAT-*, MTH-*, CST-*, JSN-*, ARR-01, MAP-01, ENC-*."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.casts import (cast_ums, convert_property, decimal_text, fill_defaults,
                               scale_number, try_cast_ums)
from ..functions.hashes import scala_string_hash, shard_of
from ..functions.text import (build_key, decrypt_col, from_b64, join_list, json_path,
                              map_to_string, mod, padded_hash_mod, prefix, render_template,
                              sampling_group, strip_ws, sub, suffix, to_b64, to_json_text)
from ..functions.times import (FORMATS, day_id, format_ts, from_epoch_us, is_valid_ts, month_id,
                               parse_ts, to_epoch_ms, week_id)
from ..sinks.encode import Arr, Leaf, Obj, shape_json
from .base import SQL_CHANGES, changes, query, table

W = "WITH " + SQL_CHANGES


@query("str_01_build_key", """
    SELECT event_id, md5(event_type) || '_' || COALESCE(left(CAST(CASE WHEN user_id % 3 <> 0 THEN user_id END AS VARCHAR), 2), 'N/A')
        || '|' || reverse(CAST(event_id AS VARCHAR)) || CAST(abs(event_id - 500) % 16 AS VARCHAR) AS key FROM events""")
def str_01(spark, sf):
    e = table(spark, sf, "events").withColumns({
        "who": F.when(F.col("user_id") % 3 != 0, F.col("user_id")),
        "off": F.col("event_id") - 500})
    return e.select("event_id", build_key(
        "md5(event_type) + '_' + sub(who, 2) + '|' + reverse(event_id) + mod(abs(off), 16)")
        .alias("key"))


@query("str_02_md5", "SELECT doc_id, md5(text) AS digest FROM documents")
def str_02(spark, sf):
    return table(spark, sf, "documents").select("doc_id", build_key("md5(text)").alias("digest"))


def _murmur(text: str) -> str:
    """The 32-bit hash of a text of basic-plane characters, in SQL."""
    def scramble(x):
        t = f"(({x}) * 3432918353 % 4294967296)"
        return f"((({t} * 32768) % 4294967296 + {t} // 131072) * 461845907 % 4294967296)"

    def unit(i):
        return f"unicode({text}[{i}])::UHUGEINT"
    mixed = "xor(h, k)"
    step = (f"((({mixed} * 8192) % 4294967296 + {mixed} // 524288) * 5 + 3864292196)"
            " % 4294967296")
    blocks = (f"list_transform(range(length({text}) // 2), lambda j: "
              f"{scramble('(' + unit('2 * j + 1') + ') * 65536 + ' + unit('2 * j + 2'))})")
    body = f"list_reduce({blocks}, lambda h, k: {step}, 4157243346::UHUGEINT)"
    tail = f"CASE WHEN length({text}) % 2 = 1 THEN {scramble(unit(f'length({text})'))} ELSE 0 END"
    last = f"xor(xor({body}, ({tail})::UHUGEINT), length({text})::UHUGEINT)"
    return last


def _murmur_query(source: str, key: str, text: str, out: str) -> str:
    return f"""
    WITH a AS (SELECT {key}, {_murmur(text)} AS h FROM {source}),
    b AS (SELECT {key}, xor(h, h // 65536) * 2246822507 % 4294967296 AS h FROM a),
    c AS (SELECT {key}, xor(h, h // 8192) * 3266489909 % 4294967296 AS h FROM b),
    d AS (SELECT {key}, xor(h, h // 65536)::BIGINT AS h FROM c),
    e AS (SELECT {key}, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS h FROM d)
    SELECT {key}, {out} FROM e"""


@query("str_03_string_hash", _murmur_query("documents", "doc_id", "source", "h"))
def str_03(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", scala_string_hash(F.col("source")).alias("h"))


@query("str_04_abs_mod", """
    SELECT event_id, abs(event_id - 500) AS a, (event_id - 500) % 7 AS m FROM events""")
def str_04(spark, sf):
    x = F.col("event_id") - 500
    return table(spark, sf, "events").select("event_id", F.abs(x).alias("a"), mod(x, 7).alias("m"))


@query("str_05_sub", """
    SELECT p_partkey, left(p_name, 4) AS head, right(p_name, 4) AS tail, left(p_name, 100) AS whole FROM part""")
def str_05(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", sub("p_name", 4).alias("head"), sub("p_name", -4).alias("tail"),
        sub("p_name", 100).alias("whole"))


@query("str_06_reverse", "SELECT p_partkey, reverse(p_name) AS r FROM part")
def str_06(spark, sf):
    return table(spark, sf, "part").select("p_partkey", build_key("reverse(p_name)").alias("r"))


@query("str_07_prefix_suffix", """
    SELECT doc_id, 'x-' || l AS p, l || '-y' AS s FROM (
      SELECT d.doc_id, CASE WHEN quality = 1 THEN lang END AS l FROM documents d LEFT JOIN labels b ON d.doc_id = b.doc_id) t""")
def str_07(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    lang = F.when(F.col("quality") == 1, F.col("lang"))
    return d.select("doc_id", prefix(lang, "x-").alias("p"), suffix(lang, "-y").alias("s"))


@query("str_08_value", "SELECT p_partkey, p_brand AS key FROM part")
def str_08(spark, sf):
    return table(spark, sf, "part").select("p_partkey", build_key("value(p_brand)").alias("key"))


@query("str_09_padded_hash_mod", _murmur_query(
    "part", "p_partkey", "p_name", "lpad(abs(h % 1000)::VARCHAR, 4, '0') AS bucket"))
def str_09(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", padded_hash_mod("p_name", 1000, 4).alias("bucket"))


@query("str_10_strip_ws", r"""
    SELECT page_id, regexp_replace(html, '[ \t\n\x0B\f\r]', '', 'g') AS bare,
           regexp_replace(html, '[\t\n\x0B\f\r]', '', 'g') AS flat FROM pages""")
def str_10(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", strip_ws("html").alias("bare"), strip_ws("html", True).alias("flat"))


@query("str_11_render_template", """
    SELECT event_id, 'http://h/' || CAST(user_id AS VARCHAR) || '/' || event_type || '?x=' || '${other}' AS url FROM events""")
def str_11(spark, sf):
    return table(spark, sf, "events").select("event_id", render_template(
        "http://h/${user_id}/${event_type}?x=${other}", ["user_id", "event_type"]).alias("url"))


@query("dat_01_parse_ts", """
    SELECT event_id, date_trunc('milliseconds', ts) AS dash, date_trunc('milliseconds', ts) AS slash,
           date_trunc('milliseconds', ts) AS t_form, date_trunc('second', ts) AS undelimited, date_trunc('milliseconds', ts) AS undelimited_ms,
           date_trunc('minute', ts) AS minutes, date_trunc('hour', ts) AS hours, date_trunc('day', ts) AS day, date_trunc('day', ts) AS day_nod,
           date_trunc('milliseconds', ts) AS colon_fraction, date_trunc('second', ts) + INTERVAL 7 MILLISECOND AS short_fraction,
           date_trunc('second', ts) + INTERVAL 8 HOUR AS zulu, date_trunc('second', ts) AS no_blank, CAST(NULL AS TIMESTAMP) AS bad
    FROM events""")
def dat_01(spark, sf):
    def text(fmt):
        return F.date_format("ts", fmt)

    return table(spark, sf, "events").select(
        "event_id", parse_ts(text("yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("dash"),
        parse_ts(text("yyyy/MM/dd HH:mm:ss.SSS")).alias("slash"),
        parse_ts(text("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("t_form"),
        parse_ts(text("yyyyMMddHHmmss")).alias("undelimited"),
        parse_ts(text("yyyyMMddHHmmssSSS")).alias("undelimited_ms"),
        parse_ts(text("yyyy-MM-dd HH:mm")).alias("minutes"),
        parse_ts(text(" yyyy-MM-dd HH")).alias("hours"), parse_ts(text("yyyy/MM/dd")).alias("day"),
        parse_ts(text("yyyyMMdd")).alias("day_nod"),
        parse_ts(text("yyyy-MM-dd HH:mm:ss:SSS")).alias("colon_fraction"),
        parse_ts(text("yyyy-MM-dd HH:mm:ss'.7'")).alias("short_fraction"),
        parse_ts(text("yyyy-MM-dd HH:mm:ss'Z'"), z_offset_hours=8).alias("zulu"),
        parse_ts(text("yyyy-MM-ddHH:mm:ss")).alias("no_blank"),
        parse_ts(text("'on' yyyy")).alias("bad"))


_DUCK = {"'000'": "000", "SSS": "%g", "yyyy": "%Y", "MM": "%m", "dd": "%d", "HH": "%H", "mm": "%M",
         "ss": "%S"}


def _duck_format(fmt: str) -> str:
    for java, duck in _DUCK.items():
        fmt = fmt.replace(java, duck)
    return fmt


@query("dat_02_format_ts", "SELECT event_id, " + ", ".join(
    f"strftime(ts, '{_duck_format(f)}') AS {n}" for n, f in FORMATS.items()) + " FROM events")
def dat_02(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", *[format_ts("ts", n).alias(n) for n in FORMATS])


@query("dat_03_epochs", """
    SELECT event_id, epoch_us(ts) // 1000 AS ms, date_trunc('milliseconds', ts) AS back FROM events""")
def dat_03(spark, sf):
    t = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select(
        "event_id", to_epoch_ms(t).alias("ms"), from_epoch_us(F.unix_micros(t)).alias("back"))


@query("dat_04_ordinals", """
    SELECT o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CAST(t AS DATE)) AS INTEGER) AS d,
           CAST(floor(date_diff('day', DATE '1969-12-29', CAST(t AS DATE)) / 7) AS INTEGER) AS w,
           CAST((year(t) - 1970) * 12 + month(t) - 1 AS INTEGER) AS m FROM (SELECT o_orderkey, o_orderdate AS t FROM orders) o""")
def dat_04(spark, sf):
    t = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf, "orders").select(
        "o_orderkey", day_id(t).alias("d"), week_id(t).alias("w"), month_id(t).alias("m"))


@query("dat_06_is_valid_ts", """
    SELECT event_id, event_type <> 'error' AS ok, FALSE AS wrong_format FROM events""")
def dat_06(spark, sf):
    text = F.when(F.col("event_type") == "error", "2024-13-99 10:00:00") \
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf, "events").select("event_id", text.alias("t")).select(
        "event_id", is_valid_ts("t", "ts_dash_sec").alias("ok"),
        is_valid_ts("t", "ts_slash_sec").alias("wrong_format"))


@query("mth_01_sampling_group", """
    SELECT event_id, CAST(((event_id - 5000) % 64 + 64) % 64 AS INTEGER) AS g FROM events""")
def mth_01(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", sampling_group(F.col("event_id") - 5000).alias("g"))


@query("mth_02_scale_number", """
    SELECT event_id, CAST(trunc(CAST(value AS DECIMAL(18,6)) * 1000) AS BIGINT) AS thousandths FROM events""")
def mth_02(spark, sf):
    return table(spark, sf, "events").select("event_id", scale_number("value").alias("thousandths"))


def _xx_sql(text: str, seed: int) -> str:
    """64-bit xxHash of a text of less than 32 bytes, over DuckDB's 128-bit numbers."""
    m = "18446744073709551616::UHUGEINT"
    p1, p2, p3, p4, p5 = (f"{p}::UHUGEINT" for p in (
        11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579,
        2870177450012600261))

    def turn(x: str, r: int) -> str:
        return f"list_reduce([{x}, 0::UHUGEINT], lambda t, z: (t * {2 ** r}::UHUGEINT) % {m} + t // {2 ** (64 - r)}::UHUGEINT)"

    def number(at: str, width: int) -> str:
        return (f"list_sum(list_transform(range({width}), lambda j: ord(substr({text}, ({at} + j + 1)::INT, 1))"
                f"::HUGEINT * (1::HUGEINT << (8 * j))))::UHUGEINT")
    eight = turn(f"({number('8 * k', 8)} * {p2}) % {m}", 31)
    h = (f"list_reduce(list_concat([({seed} + {p5} + length({text})::UHUGEINT) % {m}], range(length({text}) // 8)::UHUGEINT[]), "
         f"lambda h, k: ({turn(f'xor(h, ({eight} * {p1}) % {m})', 27)} * {p1} + {p4}) % {m})")
    done = f"(length({text}) // 8 * 8)"
    h = (f"list_reduce([{h}, 0::UHUGEINT], lambda h, z: CASE WHEN length({text}) % 8 >= 4 THEN "
         f"({turn(f'xor(h, ({number(done, 4)} * {p1}) % {m})', 23)} * {p2} + {p3}) % {m} ELSE h END)")
    h = (f"list_reduce(list_concat([{h}], range(length({text}) // 4 * 4, length({text}))::UHUGEINT[]), lambda h, k: "
         f"({turn(f'xor(h, ({number('k', 1)} * {p5}) % {m})', 11)} * {p1}) % {m})")
    return (f"list_reduce([{h}, {2 ** 33}::UHUGEINT, {2 ** 29}::UHUGEINT, {2 ** 32}::UHUGEINT], lambda h, r: "
            f"xor(h, h // r) * CASE WHEN r = {2 ** 33} THEN {p2} WHEN r = {2 ** 29} THEN {p3} "
            f"ELSE 1::UHUGEINT END % {m})")


@query("mth_03_shard_of", f"""
    WITH t AS (SELECT o_orderkey, o_orderkey::VARCHAR || '_' || o_custkey::VARCHAR AS s FROM orders),
    h AS (SELECT o_orderkey, {_xx_sql('s', 0)} AS zero, {_xx_sql('s', 42)} AS own FROM t)
    SELECT o_orderkey, CAST(zero % 8 AS INTEGER) AS shard, CAST(own % 8 AS INTEGER) AS native FROM h""")
def mth_03(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", shard_of(["o_orderkey", "o_custkey"], 8, native=False).alias("shard"),
        shard_of(["o_orderkey", "o_custkey"], 8).alias("native"))


@query("cst_01_cast_ums", """
    SELECT event_id, event_type AS s, CAST(user_id AS INTEGER) AS i, event_id AS l, CAST(value AS DOUBLE) AS d,
           user_id % 2 = 0 AS b, CAST(ts AS DATE) AS day, date_trunc('second', ts) AS at,
           CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) || '0000000000000000' AS dec FROM events""")
def cst_01(spark, sf):
    e = table(spark, sf, "events")
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return e.select(
        "event_id", cast_ums("event_type", "string").alias("s"),
        cast_ums(F.col("user_id").cast("string"), "int").alias("i"),
        cast_ums(F.col("event_id").cast("string"), "long").alias("l"),
        cast_ums(F.col("value").cast("string"), "double").alias("d"),
        cast_ums((F.col("user_id") % 2 == 0).cast("string"), "boolean").alias("b"),
        cast_ums(at, "date").alias("day"), cast_ums(at, "datetime").alias("at"),
        cast_ums(F.col("value").cast("decimal(12,2)").cast("string"), "decimal")
        .cast("string").alias("dec"))


@query("cst_02_try_cast", """
    SELECT doc_id, TRY_CAST(lang AS INTEGER) AS i, TRY_CAST(CAST(n_chars AS VARCHAR) AS BIGINT) AS l,
           TRY_CAST(CASE WHEN doc_id % 2 = 0 THEN 'x' ELSE '1.5' END AS DOUBLE) AS d FROM documents""")
def cst_02(spark, sf):
    mixed = F.when(F.col("doc_id") % 2 == 0, "x").otherwise("1.5")
    return table(spark, sf, "documents").select(
        "doc_id", try_cast_ums("lang", "int").alias("i"),
        try_cast_ums(F.col("n_chars").cast("string"), "long").alias("l"),
        try_cast_ums(mixed, "double").alias("d"))


@query("cst_03_convert_property", """
    SELECT event_id, CAST(trunc(CAST(value AS DECIMAL(18,6)) * 1000) AS BIGINT) AS num, 0 AS bad_num, event_type AS str,
           CASE WHEN event_type = 'view' THEN '' ELSE event_type || ',b' END AS list, epoch_us(ts) // 1000 AS at,
           CAST(0 AS BIGINT) AS bad_at, CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS flag FROM events""")
def cst_03(spark, sf):
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        "event_id", convert_property(F.col("value").cast("string"), "number").alias("num"),
        convert_property("event_type", "number").alias("bad_num"),
        convert_property("event_type", "string").alias("str"),
        convert_property(F.when(kind != "view", F.to_json(F.array(
            F.concat(F.lit(" "), kind), F.lit(" "), F.lit("b")))), "list").alias("list"),
        convert_property(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), "datetime").alias("at"),
        convert_property("event_type", "date").alias("bad_at"),
        convert_property((F.col("user_id") % 2 == 0).cast("string"), "bool").alias("flag"))


@query("cst_04_decimal_text", """
    SELECT event_id, rtrim(rtrim(CAST(CAST(value AS DECIMAL(18,6)) AS VARCHAR), '0'), '.') AS stripped,
           CAST(CAST(value AS DECIMAL(18,6)) AS VARCHAR) || '000000000000' AS plain FROM events""")
def cst_04(spark, sf):
    v = F.col("value").cast("decimal(18,6)")
    return table(spark, sf, "events").select(
        "event_id", decimal_text(v).alias("stripped"), decimal_text(v, strip=False).alias("plain"))


@query("cst_05_fill_defaults", """
    SELECT event_id, COALESCE(c_name, '') AS c_name, COALESCE(o_totalprice, 0) AS o_totalprice,
           COALESCE(o_orderdate, TIMESTAMP '1970-01-01 00:00:00') AS o_orderdate
    FROM events LEFT JOIN customer ON user_id = CASE WHEN c_nationkey < 10 THEN c_custkey END
    LEFT JOIN orders ON event_id * 2 = o_orderkey""")
def cst_05(spark, sf):
    # misses by expression: every row is read, some have no key
    some = F.when(F.col("c_nationkey") < 10, F.col("c_custkey"))
    e = table(spark, sf, "events").join(table(spark, sf, "customer"), F.col("user_id") == some,
                                        "left") \
        .join(table(spark, sf, "orders"), F.col("event_id") * 2 == F.col("o_orderkey"), "left")
    return fill_defaults(e.select("event_id", "c_name", "o_totalprice", "o_orderdate"))


@query("jsn_01_to_json_text", """
    SELECT event_id, '{"id":' || CAST(event_id AS VARCHAR) || ',"who":' || COALESCE(CAST(CASE WHEN user_id % 2 = 0 THEN user_id END AS VARCHAR), 'null')
        || ',"list":["' || event_type || '",null]}' AS j FROM events""")
def jsn_01(spark, sf):
    return table(spark, sf, "events").select("event_id", to_json_text(F.struct(
        F.col("event_id").alias("id"), F.when(F.col("user_id") % 2 == 0, F.col("user_id"))
        .alias("who"), F.array("event_type", F.lit(None).cast("string")).alias("list"))).alias("j"))


@query("jsn_02_shape_json", f"""{W}
    SELECT ums_id_, '{{"id":' || CAST(ums_id_ AS VARCHAR) || ',"who":{{"key":' || CAST(k AS VARCHAR) || ',"kind":"' || value1
        || '","absent":null}},"tags":["' || value1 || '","' || ums_uid_ || '"],"ums_active_":'
        || CASE WHEN ums_op_ = 'd' THEN '0' ELSE '1' END || '}}' AS j FROM changes""")
def jsn_02(spark, sf):
    c = changes(spark, sf)
    spec = [Leaf("id", column="ums_id_"), Obj("who", [
        Leaf("key", column="k"), Leaf("kind", column="value1"), Leaf("absent", "string")]),
        Arr("tags", [Leaf("a", column="value1"), Leaf("b", column="ums_uid_")]), Leaf("ums_op_")]
    return c.select("ums_id_", to_json_text(shape_json(spec, c.columns)).alias("j"))


@query("jsn_03_json_path", """
    SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, event_type AS second FROM events""")
def jsn_03(spark, sf):
    doc = F.to_json(F.struct(F.struct(F.array(F.lit("x"), F.col("event_type")).alias("b"))
                             .alias("a")))
    return table(spark, sf, "events").select(
        "event_id", json_path("props", "k").alias("k"), json_path(doc, "a.b[1]").alias("second"))


@query("arr_01_join_list", """
    SELECT event_id, event_type || ',b,' || event_type AS every, event_type || ',b' AS uniq,
           CAST(NULL AS VARCHAR) AS none FROM events""")
def arr_01(spark, sf):
    kind = F.col("event_type")
    items = F.array(F.concat(F.lit(" "), kind), F.lit(" \t"), F.lit("b"), F.lit(None), kind)
    return table(spark, sf, "events").select(
        "event_id", join_list(items).alias("every"), join_list(items, distinct=True).alias("uniq"),
        join_list(F.array(F.lit(" "), F.lit(None).cast("string"))).alias("none"))


@query("map_01_map_to_string", """
    SELECT event_id, CASE WHEN event_type = 'view' THEN '{}' ELSE '{"' || event_type || '":' || CAST(user_id AS VARCHAR) || '}' END AS m
    FROM events""")
def map_01(spark, sf):
    m = F.when(F.col("event_type") != "view", F.create_map("event_type", "user_id"))
    return table(spark, sf, "events").select("event_id", map_to_string(m).alias("m"))


@query("enc_01_base64", """
    SELECT doc_id, to_base64(encode(text)) AS b, text AS back FROM documents""")
def enc_01(spark, sf):
    b = to_b64("text")
    return table(spark, sf, "documents").select(
        "doc_id", b.alias("b"), from_b64(b).cast("string").alias("back"))


@query("enc_02_decrypt", """
    SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type || ':' || CAST(user_id AS VARCHAR) END AS clear FROM events""")
def enc_02(spark, sf):
    key = "0123456789abcdef"  # an example key for example data
    text = F.concat_ws(":", "event_type", F.col("user_id").cast("string"))
    sealed = F.when(F.col("event_type") != "error", F.hex(F.aes_encrypt(
        text, F.lit(key), F.lit("ECB")))).otherwise("not hex")
    return table(spark, sf, "events").select("event_id", sealed.alias("sealed")) \
        .select("event_id", decrypt_col("sealed", key).alias("clear"))
