"""Insert/update/delete logs: merge, snapshot, upsert plans (CDC-*).

"Latest row per key" is a ``row_number() = 1`` filter.  Spark runs it with a group
limit on both sides of the exchange, so each task sends one row per key whatever
the key's share of the log.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.times import parse_ts
from ..model import ACTIVE, BEFORE, DELETE, ID, OP, TS, UID
from ..session import cut_lineage

SKIP = "skip"


def _version_order(df: DataFrame) -> list[Column]:
    """Newest first; equal versions are ordered by time, then by the row identity.

    Without an identity column a hash of the row decides, which reads all columns.
    """
    order = [F.col(ID).desc()]
    if TS in df.columns:
        order.append(F.col(TS).desc())
    if UID in df.columns:
        return [*order, F.col(UID).desc()]
    hashable = [f.name for f in df.schema.fields if f.dataType.typeName() != "map"]
    order.append(F.xxhash64(*[F.col(f"`{c}`") for c in hashable]).desc())
    return order


def _latest(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*_version_order(df))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def merge_latest(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """CDC-01: newest row per key without before-images; deletes survive as rows."""
    if OP in df.columns:
        df = df.filter(F.col(OP).isNull() | (F.col(OP) != BEFORE))
    return _latest(df, keys)


def snapshot(df: DataFrame, keys: Sequence[str], start: str | None = None,
             end: str | None = None) -> DataFrame:
    """CDC-02: the table at a time range: newest row per key, deleted keys left out."""
    rows = _latest(_in_range(df, start, end), keys)
    return rows.filter(F.lower(F.col(OP)) != DELETE)


def increment_by_ts(df: DataFrame, keys: Sequence[str], from_: str, to: str) -> DataFrame:
    """CDC-03: as :func:`snapshot`, the end widened by 999 ms and only ``d`` removed."""
    high = parse_ts(F.lit(to)) + F.expr("INTERVAL '0.999' SECOND")
    rows = df.filter(F.col(TS).between(_bound(df, parse_ts(F.lit(from_))), _bound(df, high)))
    return _latest(rows, keys).filter(F.col(OP) != DELETE)


def _in_range(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    if start is not None:
        df = df.filter(F.col(TS) >= _bound(df, parse_ts(F.lit(start))))
    if end is not None:
        df = df.filter(F.col(TS) <= _bound(df, parse_ts(F.lit(end))))
    return df


def _bound(df: DataFrame, constant: Column) -> Column:
    # in the column's own type, so that the column is compared without a cast
    return constant.cast(df.schema[TS].dataType)


def with_active(df: DataFrame) -> DataFrame:
    """CDC-05: the operation replaced by a live flag, 0 for a delete and 1 otherwise."""
    return df.withColumn(ACTIVE, F.when(F.col(OP) == DELETE, 0).otherwise(1)).drop(OP)


def plan_upsert(df: DataFrame, target: DataFrame, keys: Sequence[str],
                null_id_updates: bool = False, version: str = ID) -> DataFrame:
    """CDC-04, SNK-13, SNK-16, SNK-17: what a guarded write would do with each key.

    The newest incoming row per key gets ``action``: ``i`` when the key is not in
    the target, ``u`` when its version is greater than the stored one, otherwise
    ``skip``.  ``null_id_updates`` also updates where the stored version is null.
    """
    latest = merge_latest(df, keys)
    stored = target.select(*[F.col(k).alias(f"_k_{k}") for k in keys],
                           F.col(version).alias("_stored"), F.lit(True).alias("_found"))
    joined = latest.join(stored, [F.col(k) == F.col(f"_k_{k}") for k in keys], "left")
    newer = F.col(version) > F.col("_stored")
    if null_id_updates:
        newer = newer | F.col("_stored").isNull()
    action = F.when(F.col("_found").isNull(), F.lit("i")) \
        .when(newer, F.lit("u")).otherwise(F.lit(SKIP))
    return joined.withColumn("action", action) \
        .drop("_stored", "_found", *[f"_k_{k}" for k in keys])


def to_target(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first load of a target table: newest row per key with its live flag."""
    return with_active(merge_latest(df, keys))


def apply_changes(target: DataFrame, changes: DataFrame, keys: Sequence[str],
                  mutation: str = "iud") -> DataFrame:
    """CDC-06, CDC-07: the target after the changes; applying them twice changes nothing.

    ``iud``: one row per key; an incoming row replaces the stored one only when its
    version is greater or the stored one has none; a delete keeps the row with live flag 0.  ``i``: blind
    append.  ``target`` has the changes' columns with the live flag in place of the
    operation, and one row per key.
    """
    if mutation == "i":
        return target.unionByName(with_active(changes))
    if mutation != "iud":
        raise ValueError(f"unknown mutation {mutation!r}")
    columns = target.columns
    value_columns = [c for c in columns if c not in keys]
    new = with_active(merge_latest(changes, keys)).select(
        *keys, F.struct(*value_columns).alias("_new"))
    old = target.select(*keys, F.struct(*value_columns).alias("_old"))
    both = old.join(new, list(keys), "full_outer")
    # a stored row without a version is always replaced, as in the relational sink
    take_new = F.col("_new").isNotNull() & (
        F.col("_old").isNull() | F.col(f"_old.{ID}").isNull()
        | (F.col(f"_new.{ID}") > F.col(f"_old.{ID}")))
    chosen = F.when(F.coalesce(take_new, F.lit(False)), F.col("_new")).otherwise(F.col("_old"))
    return both.select(*keys, chosen.alias("_v")) \
        .select(*[F.col(c) if c in keys else F.col(f"_v.{c}").alias(c) for c in columns])


def plan_split_upsert(df: DataFrame, master: DataFrame, meta: DataFrame, keys: Sequence[str]
                      ) -> DataFrame:
    """CDC-08: action class of each key for a master table and a version table.

    ``<master>_<meta>`` with master one of ``i u d none`` and meta ``i`` or ``u``.
    A key in the version table acts only when the incoming version is greater;
    others get ``skip``.
    """
    latest = merge_latest(df, keys)
    m = master.select(*[F.col(k).alias(f"_m_{k}") for k in keys], F.lit(True).alias("_in_m"))
    v = meta.select(*[F.col(k).alias(f"_v_{k}") for k in keys], F.col(ID).alias("_stored"),
                    F.lit(True).alias("_in_v"))
    joined = latest.join(m, [F.col(k) == F.col(f"_m_{k}") for k in keys], "left") \
        .join(v, [F.col(k) == F.col(f"_v_{k}") for k in keys], "left")
    in_master, in_meta = F.col("_in_m").isNotNull(), F.col("_in_v").isNotNull()
    live = F.col(OP).isin("i", "u")
    master_part = F.when(live, F.when(in_master, "u").otherwise("i")) \
        .otherwise(F.when(in_master, "d").otherwise("none"))
    plan = F.concat(master_part, F.lit("_"), F.when(in_meta, "u").otherwise("i"))
    stale = in_meta & ~F.coalesce(F.col(ID) > F.col("_stored"), F.lit(False))
    return joined.withColumn("action", F.when(stale, F.lit(SKIP)).otherwise(plan)) \
        .drop("_in_m", "_in_v", "_stored", *[f"_m_{k}" for k in keys], *[f"_v_{k}" for k in keys])


def apply_split(df: DataFrame, master: DataFrame, meta: DataFrame, keys: Sequence[str]
                ) -> tuple[DataFrame, DataFrame]:
    """CDC-08, SNK-03: master and version table after a split-table write.

    Deletes are physical in the master; the version table keeps id, time and flag.
    The plan is written once, and both tables are built on it.
    """
    plan = cut_lineage(plan_split_upsert(df, master, meta, keys).filter(F.col("action") != SKIP))
    live = plan.filter(F.col(OP).isin("i", "u"))
    kept = master.join(plan.select(*keys), list(keys), "left_anti")
    columns = master.columns
    new_master = kept.unionByName(live.select(*columns))
    new_meta = meta.join(plan.select(*keys), list(keys), "left_anti") \
        .unionByName(with_active(plan).select(*meta.columns))
    return new_master, new_meta


def partition_by_keys(df: DataFrame, keys: Sequence[str], n: int | None = None) -> DataFrame:
    """CDC-09: all rows of a key in one partition, for writers that need per-key order.

    Merge first (:func:`merge_latest`), so that a key is one row here.
    """
    return df.repartition(n, *keys) if n else df.repartition(*keys)


def dedup(df: DataFrame, cols: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """CDC-10: one row per combination of ``cols``; the first by ``order_by`` when given.

    Without an order any row may stay, and on a stream the frame needs a watermark.
    """
    if not order_by:
        return df.dropDuplicates(list(cols))
    w = Window.partitionBy(*cols).orderBy(*order_by)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
