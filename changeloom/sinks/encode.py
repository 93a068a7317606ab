"""Message encoders and routing (SNK-04..08, SNK-11, JSN-02)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import md5

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.casts import decimal_text
from ..model import (ACTIVE, BATCH, DELETE, INCREMENT, OP, SYSTEM_PREFIX, declared_type)
from ..functions.hashes import murmur3_utf16
from ..functions.text import to_b64
from ..sources.messages import match_namespace

MESSAGE_ROWS = 50


def cell_text(field: T.StructField) -> Column:
    """A cell as the text a message tuple carries; null stays null."""
    c, dt = F.col(f"`{field.name}`"), field.dataType
    if isinstance(dt, T.BinaryType):
        return to_b64(c)
    if isinstance(dt, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c, {"ignoreNullFields": "false"})
    if isinstance(dt, T.DecimalType):
        return decimal_text(c, strip=False)
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return c.cast("string")


def schema_version(names: Sequence[str]) -> int:
    """Version part of an output namespace: a hash of the column names."""
    return abs(murmur3_utf16(",".join(names)))


def to_ums(df: DataFrame, namespace: str, limit: int = MESSAGE_ROWS, protocol: str = INCREMENT,
           key: str | None = None) -> DataFrame:
    """SNK-04: rows packed ``limit`` per message with the schema in every message.

    Columns ``key`` and ``value``.  Each tuple becomes JSON text in the JVM; packing
    joins those texts within a partition, so nothing is shuffled and a task holds one
    Arrow batch and one message.  The namespace's version part becomes a hash of
    the column names, ``*`` after it becomes 0.  A message's key ends in a hash of its
    body, so messages spread over a queue's partitions and a repeated task sends the
    same keys.
    """
    import json
    parts = namespace.split(".")
    parts[4] = str(schema_version([f.name for f in df.schema.fields]))
    ns = ".".join([*parts[:5], *["0" if p == "*" else p for p in parts[5:]]])
    head = json.dumps({"protocol": {"type": protocol}, "schema": {
        "namespace": ns,
        "fields": [{"name": f.name, "type": _wire_type(f.dataType), "nullable": f.nullable}
                   for f in df.schema.fields]}}, separators=(",", ":"))[:-1] + ',"payload":['
    message_key = key or f"{protocol}.{ns}"
    tuples = df.select(F.to_json(F.struct(F.array(*[cell_text(f) for f in df.schema.fields])
                                          .alias("tuple"))).alias("t"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[str] = []
        for pdf in batches:
            held += pdf["t"].tolist()
            full = len(held) - len(held) % limit
            if full:
                yield _messages([held[i:i + limit] for i in range(0, full, limit)])
                held = held[full:]
        if held:
            yield _messages([held])

    def _messages(groups: list[list[str]]) -> pd.DataFrame:
        values = [head + ",".join(g) + "]}" for g in groups]
        return pd.DataFrame({"key": [f"{message_key}...{md5(v.encode()).hexdigest()}"
                                     for v in values], "value": values})

    return tuples.mapInPandas(pack, "key string, value string")


def _wire_type(dt: T.DataType) -> str:
    name = declared_type(dt)
    return "string" if name.startswith("json") else name


def to_flat_json(df: DataFrame, namespace: str = "", protocol: str = INCREMENT,
                 system: bool = True) -> DataFrame:
    """SNK-05, SNK-06: one typed JSON text per row in ``value``, nulls written.

    With system columns the namespace and protocol are added; without, every column
    that starts with ``ums_`` is left out.
    """
    columns = [c for c in df.columns if system or not c.startswith(SYSTEM_PREFIX)]
    extra = [F.lit(namespace).alias("namespace"), F.lit(protocol).alias("protocol")] \
        if system else []
    return df.select(F.to_json(F.struct(*extra, *[F.col(f"`{c}`") for c in columns]),
                               {"ignoreNullFields": "false"}).alias("value"))


@dataclass(frozen=True)
class Leaf:
    """A leaf of a nested output: column (default its name) and type."""

    name: str
    type: str = ""
    column: str = ""


@dataclass(frozen=True)
class Obj:
    """A nested object of leaves, objects and arrays."""

    name: str
    fields: Sequence["Leaf | Obj | Arr"] = ()


@dataclass(frozen=True)
class Arr:
    """An array of objects, one per group of fields, or of plain values."""

    name: str
    items: Sequence["Leaf | Obj"] = ()


def shape_json(spec: Sequence[Leaf | Obj | Arr], columns: Sequence[str]) -> Column:
    """JSN-02: a nested struct from flat columns as declared.

    A leaf whose column is absent is null; the operation column becomes the live
    flag.
    """
    have = {c.lower() for c in columns}
    return F.struct(*[_shape(node, have).alias(_out_name(node)) for node in spec])


def _out_name(node) -> str:
    return ACTIVE if isinstance(node, Leaf) and node.name == OP else node.name


def _shape(node: Leaf | Obj | Arr, have: set[str]) -> Column:
    if isinstance(node, Obj):
        return F.struct(*[_shape(f, have).alias(_out_name(f)) for f in node.fields])
    if isinstance(node, Arr):
        return F.array(*[_shape(f, have) for f in node.items])
    source = (node.column or node.name).lower()
    if source not in have:
        c = F.lit(None)
    elif source == OP:
        c = F.when(F.col(OP) == DELETE, 0).otherwise(1)
    else:
        c = F.col(source)
    return c.cast(node.type) if node.type else c


def to_nested_json(df: DataFrame, spec: Sequence[Leaf | Obj | Arr]) -> DataFrame:
    """SNK-07: one nested JSON text per row in ``value``."""
    return df.select(F.to_json(shape_json(spec, df.columns), {"ignoreNullFields": "false"})
                     .alias("value"))


def message_keys(df: DataFrame, namespace: str, protocol: str = "", topic: str = "") -> DataFrame:
    """SNK-08: add the queue key ``protocol.namespace...uuid``.

    The protocol is batch data when a topic is named outright, increment data
    otherwise.  The unique part is a hash of the value, so a task that runs twice
    writes the same keys.
    """
    kind = protocol or (BATCH if topic else INCREMENT)
    return df.withColumn("key", F.concat(F.lit(f"{kind}.{namespace}..."), F.md5("value")))


@dataclass(frozen=True)
class Route:
    """Messages of ``source`` (a name rule) are copied to ``target`` on ``topic``."""

    source: str
    target: str
    topic: str = ""


def route(df: DataFrame, rules: Sequence[Route], key_col: str = "key", value_col: str = "value"
          ) -> DataFrame:
    """SNK-11: a copy of each message per matching rule, namespace rewritten.

    ``*`` parts of a target are taken from the message's own name.  The body's
    namespace is rewritten where it is a schema-carrying message; other bodies pass
    unchanged.  Columns ``topic``, ``key`` and ``value``.  The rules are few and are
    expanded per row, without a join.
    """
    parts = F.split(F.col(key_col), r"\.")
    name = F.array_join(F.slice(parts, 2, 7), ".")
    copies = []
    for rule in rules:
        target = rule.target.split(".") + ["*"] * (7 - len(rule.target.split(".")))
        renamed = F.concat_ws(".", *[parts[i + 1] if t == "*" else F.lit(t)
                                     for i, t in enumerate(target)])
        copies.append(F.when(match_namespace(name, rule.source),
                             F.struct(F.lit(rule.topic).alias("topic"), renamed.alias("ns"))))
    old = F.get_json_object(value_col, "$.schema.namespace")
    hit = df.filter(F.size(parts) >= 8) \
        .select("*", F.explode(F.array_compact(F.array(*copies))).alias("_to"),
                parts.alias("_parts"), old.alias("_old"))
    tail = F.when(F.size("_parts") > 8, F.concat(F.lit("."), F.array_join(
        F.slice("_parts", F.lit(9), F.size("_parts")), "."))).otherwise(F.lit(""))
    # the first namespace after the schema's brace, blanks or not; nothing else is touched
    where = F.concat(F.lit(r'(?s)^(.*?"schema"\s*:\s*\{.*?"namespace"\s*:\s*")\Q'), F.col("_old"),
                     F.lit(r'\E(")'))
    body = F.when(F.col("_old").isNull(), F.col(value_col)).otherwise(F.regexp_replace(
        F.col(value_col), where, F.concat(F.lit("$1"), F.replace(
            F.col("_to.ns"), F.lit("$"), F.lit("\\$")), F.lit("$2"))))
    return hit.select(F.col("_to.topic").alias("topic"),
                      F.concat(F.col("_parts")[0], F.lit("."), F.col("_to.ns"), tail).alias("key"),
                      body.alias("value"))
