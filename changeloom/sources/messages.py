"""Schema-carrying messages: decoding, typing, keys and routing filters (SRC-01, 02, 10..13)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.casts import try_cast_ums
from ..functions.times import normalize_ts
from ..model import DATA_PROTOCOLS, HEARTBEAT, INCREMENT, TIME_PROTOCOLS, Field

ENVELOPE = ("protocol struct<type:string>,"
            "schema struct<namespace:string,fields:array<struct<name:string,type:string,"
            "nullable:boolean>>>,"
            "payload array<struct<tuple:array<string>>>")
BAD = "_bad"


def read_ums(df: DataFrame, value_col: str = "value", key_col: str | None = None,
             keep: Sequence[str] = ()) -> DataFrame:
    """SRC-01: one row per payload tuple of the message in ``value_col``.

    Columns: ``protocol``, ``namespace``, ``fields`` (declared name, type, nullable)
    and ``tuple`` (texts, null kept), then ``keep``.  Names are lower-cased, a
    missing ``nullable`` is false and a message without payload gives no row.  With
    ``key_col`` protocol and namespace come from the key where it has them.
    """
    m = df.select(*([key_col] if key_col and key_col not in keep else []), *keep, value_col,
                  F.from_json(F.col(value_col), ENVELOPE).alias("_m"))
    if key_col:
        m = classify_messages(m, key_col, value_col)
    else:
        m = m.withColumns({"protocol": F.lower("_m.protocol.type"),
                           "namespace": F.lower("_m.schema.namespace")})
    fields = F.transform("_m.schema.fields", lambda f: F.named_struct(
        F.lit("name"), F.lower(f["name"]), F.lit("type"), f["type"],
        F.lit("nullable"), F.coalesce(f["nullable"], F.lit(False))))
    # Names are lower-cased once per message, below the explode.  The outer form keeps the
    # optimizer from testing the payload's size first, which would parse the text twice.
    return m.select("protocol", "namespace", *keep, fields.alias("fields"),
                    F.col("_m.payload.tuple").alias("_p")) \
        .select("protocol", "namespace", "fields", F.explode_outer("_p").alias("tuple"), *keep) \
        .filter(F.col("tuple").isNotNull())


def malformed(df: DataFrame, value_col: str = "value") -> DataFrame:
    """Messages that do not decode: no JSON object, or neither schema nor payload."""
    m = F.from_json(F.col(value_col), ENVELOPE)
    return df.withColumn("_m", m).filter(
        F.col("_m").isNull() | F.col("_m.schema").isNull()
        | F.col("_m.schema.fields").isNull()).drop("_m")


def apply_ums_schema(df: DataFrame, fields: Sequence[Field], keep: Sequence[str] = (),
                     bad: str = "drop") -> DataFrame:
    """SRC-02: tuple cells to typed columns, found by declared name.

    A row with a cell that does not convert is bad: ``bad="drop"`` leaves it out,
    ``"only"`` returns just such rows (typed columns, ``tuple`` and ``keep``) and
    ``"flag"`` adds a boolean ``_bad``.
    """
    raw = {f.name: F.get(F.col("tuple"), F.array_position("fields.name", F.lit(f.name.lower()))
                         .cast("int") - 1) for f in fields}
    cells = df.select("tuple", *keep, *[c.alias(f"_raw_{n}") for n, c in raw.items()])
    return _typed(cells, [(f.name, f"_raw_{f.name}", f.type) for f in fields], keep, bad,
                  extra=["tuple"])


def _typed(df: DataFrame, columns: Sequence[tuple[str, str, str]], keep: Sequence[str], bad: str,
           extra: Sequence[str] = (), also_bad: Column | None = None) -> DataFrame:
    """Cast raw text columns and apply the bad-row policy (raw present, typed null).

    The type ``event_time`` reads a time given as text or as an epoch number (SRC-09).
    """
    typed = [(normalize_ts(raw) if t == "event_time" else try_cast_ums(raw, t)).alias(name)
             for name, raw, t in columns]
    passed = [*extra, *keep, *[raw for _, raw, _ in columns],
              *([also_bad.alias("_also")] if also_bad is not None else [])]
    # a generator of one row: a filter is not pushed through it, so each cast runs once
    out = df.select(*passed, F.inline_outer(F.array(F.struct(*typed))))
    is_bad = F.lit(False) if also_bad is None else F.col("_also")
    for name, raw, t in columns:
        if t != "string":
            is_bad = is_bad | (F.col(raw).isNotNull() & F.col(name).isNull())
    names = [name for name, _, _ in columns]
    if bad == "flag":
        return out.select(*keep, *names, is_bad.alias(BAD))
    if bad == "only":
        return out.filter(is_bad).select(*extra, *keep, *names)
    if bad == "drop":
        return out.filter(~is_bad).select(*keep, *names)
    raise ValueError(f"bad must be drop, only or flag, not {bad!r}")


def classify_messages(df: DataFrame, key_col: str = "key", value_col: str = "value") -> DataFrame:
    """SRC-10: add ``protocol`` and ``namespace`` from the message key.

    ``protocol.p1...p7[...]``: first part and next seven, lower-cased; fewer parts
    give an empty namespace; a null key or unknown protocol is a heartbeat with an
    empty namespace; a blank key takes both from the body, where the protocol
    defaults to increment data.
    """
    key = F.col(key_col)
    parts = F.split(F.lower(key), r"\.")
    known = parts[0].isin(*DATA_PROTOCOLS, *TIME_PROTOCOLS) \
        | parts[0].rlike("^(directive|feedback)_")
    blank = F.trim(key) == ""
    body_protocol = F.get_json_object(value_col, "$.protocol.type")
    body_namespace = F.get_json_object(value_col, "$.schema.namespace")
    return df.withColumns({
        "protocol": F.when(key.isNull(), F.lit(HEARTBEAT))
        .when(blank, F.coalesce(F.lower(body_protocol), F.lit(INCREMENT)))
        .when(known, parts[0]).otherwise(F.lit(HEARTBEAT)),
        "namespace": F.when(key.isNull(), F.lit(""))
        .when(blank, F.lower(body_namespace))
        .when(known & (F.size(parts) > 7), F.array_join(F.slice(parts, 2, 7), "."))
        .otherwise(F.lit(""))})


def rename_keys(df: DataFrame, key_col: str = "key", topic_col: str = "topic",
                default_key: str | None = None, by_topic: Mapping[str, str] | None = None,
                by_topic_key: Mapping[tuple[str, str], str] | None = None) -> DataFrame:
    """SRC-11: replace message keys; default key, then per topic, then per (topic, key)."""
    if default_key is not None:
        return df.withColumn(key_col, F.lit(default_key))
    key, topic = F.col(key_col), F.col(topic_col)
    chain: Column | None = None

    def branch(cond: Column, value: str) -> None:
        nonlocal chain
        chain = F.when(cond, F.lit(value)) if chain is None else chain.when(cond, F.lit(value))

    for name, renamed in (by_topic or {}).items():
        branch(topic == name, renamed)
    for (name, old), renamed in (by_topic_key or {}).items():
        branch((topic == name) & (key == old), renamed)
    return df if chain is None else df.withColumn(key_col, chain.otherwise(key))


def match_namespace(namespace: Column | str, rule: str, flavour: str = "core") -> Column:
    """SRC-12: does a seven-part name match a rule?

    ``core`` compares the first four parts, ``stream`` as many parts as stand before
    the first ``*`` from part five on, ``archive`` reads ``*`` as any text.
    """
    ns = F.col(namespace) if isinstance(namespace, str) else namespace
    parts = rule.lower().split(".")
    if flavour == "archive":
        pattern = r"\.".join(".*" if p == "*" else re.escape(p) for p in parts)
        return F.lower(ns).rlike(f"^{pattern}$")
    n = 4
    if flavour == "stream":
        n = next((i for i in range(4, min(7, len(parts))) if parts[i] == "*"), 7)
    elif flavour != "core":
        raise ValueError(f"unknown flavour {flavour!r}")
    # a prefix test instead of a split: no array per row, and it can be pushed down
    head = ".".join(parts[:n])
    low = F.lower(ns)
    return (low == head) | low.startswith(head + ".")


def filter_protocol(df: DataFrame, initial: bool = True, increment: bool = True,
                    batch: bool = True, protocol_col: str = "protocol") -> DataFrame:
    """SRC-13: keep the message classes a flow subscribes to."""
    wanted = [p for p, on in zip(DATA_PROTOCOLS, (initial, increment, batch)) if on]
    return df.filter(F.col(protocol_col).isin(*wanted))
