"""Rows shaped for document, wide-column, hash, column and analytic stores (SNK-12..20)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.casts import fill_defaults
from ..functions.hashes import shard_of
from ..functions.text import build_key, render_template
from ..model import ID, OP, UID
from ..operators.changes import SKIP, merge_latest, plan_upsert, with_active


def to_documents(df: DataFrame, id_cols: Sequence[str] = (), types: Mapping[str, str] | None = None
                 ) -> DataFrame:
    """SNK-12: ``_id`` and ``document`` (typed JSON) per row.

    The id joins the id columns with ``_``, or is random without them.  The
    operation becomes the live flag.  ``types`` casts text cells; a blank number is
    null.
    """
    shaped = with_active(df) if OP in df.columns else df
    for name, t in (types or {}).items():
        c = F.col(name)
        shaped = shaped.withColumn(name, F.when(F.trim(c.cast("string")) != "", c).try_cast(t))
    doc_id = F.concat_ws("_", *[F.col(c).cast("string") for c in id_cols]) if id_cols \
        else F.uuid()
    return shaped.select(doc_id.alias("_id"), F.to_json(
        F.struct(*shaped.columns), {"ignoreNullFields": "false"}).alias("document"))


def document_upserts(df: DataFrame, stored: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """SNK-13: newest row per document id with insert / update; older rows are left out.

    ``stored`` holds the id columns and the stored version.
    """
    return plan_upsert(df, stored, id_cols).filter(F.col("action") != SKIP)


def to_puts(df: DataFrame, rowkey: str | Column, family: str = "cf",
            version_col: str | None = None, stored: DataFrame | None = None,
            keys: Sequence[str] = ()) -> DataFrame:
    """SNK-14: row key, version and a map of cell texts per row.

    With ``version_col`` the store itself keeps the newest cell; otherwise, with
    ``stored``, only rows newer than the stored version pass.
    """
    if stored is not None and version_col is None:
        df = plan_upsert(df, stored, keys).filter(F.col("action") != SKIP).drop("action")
    key = rowkey if isinstance(rowkey, Column) else build_key(rowkey)
    keyed = df.withColumns({"_rk": key, "_version": F.col(version_col or ID).cast("long")})
    active = with_active(keyed) if OP in df.columns else keyed
    cells = [c for c in active.columns if c not in ("_rk", "_version")]
    pairs = [x for c in cells for x in (F.lit(f"{family}:{c}"), F.col(c).cast("string"))]
    return active.select(F.col("_rk").alias("rowkey"), F.col("_version").alias("version"),
                         F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())
                         .alias("cells"))


def to_hashes(df: DataFrame, keys: Sequence[str], prefix: str = "", ttl_seconds: int | None = None,
              stored: DataFrame | None = None) -> DataFrame:
    """SNK-15: ``key``, field map and time to live per row; versions compare as numbers."""
    if stored is not None:
        df = plan_upsert(df, stored, keys).filter(F.col("action") != SKIP).drop("action")
    else:
        df = merge_latest(df, keys)
    key = F.concat_ws("_", *[F.col(k).cast("string") for k in keys])
    key = F.concat(F.lit(f"{prefix}:"), key) if prefix else key
    shaped = with_active(df.withColumn("_hk", key))
    pairs = [x for c in shaped.columns if c != "_hk"
             for x in (F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("")))]
    return shaped.select(F.col("_hk").alias("key"), F.create_map(*pairs).alias("fields"),
                         F.lit(ttl_seconds).cast("int").alias("ttl"))


def newer_than_stored(df: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SNK-17: rows newer than the greatest stored version of their key.

    The store may keep several rows per key; they are reduced to one before the join.
    """
    top = stored.groupBy(*keys).agg(F.max(ID).alias(ID))
    return plan_upsert(df, top, keys).filter(F.col("action") != SKIP).drop("action")


def to_shards(df: DataFrame, keys: Sequence[str], n: int, mutation: str = "i",
              native: bool = True) -> DataFrame:
    """SNK-18: default-filled rows with their ``shard``; insert-only.

    Write with ``df.write.partitionBy("shard")`` or one filtered write per shard.
    """
    if mutation != "i":
        raise ValueError("this store takes inserts only")
    return fill_defaults(df.drop(UID)).withColumn("shard", shard_of(list(keys), n, native))


def to_requests(df: DataFrame, method: str, url_template: str, body: str = "json",
                body_columns: Sequence[str] = ()) -> DataFrame:
    """SNK-20: one request per row: method, rendered url, JSON or form body.

    Sending is the caller's hook, for example in ``foreachPartition``.
    """
    columns = list(body_columns or df.columns)
    if body == "json":
        text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    elif body == "form":
        text = F.concat_ws("&", *[F.concat(F.lit(f"{c}="), F.url_encode(
            F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in columns])
    elif body == "none":
        text = F.lit(None).cast("string")
    else:
        raise ValueError(f"unknown body {body!r}")
    return df.select(F.lit(method.upper()).alias("method"),
                     render_template(url_template, df.columns).alias("url"), text.alias("body"))
