"""Lookup joins, key-value enrichment and image pairing (JON-*).

No broadcast is forced: the planner broadcasts a side whose measured size is under
``spark.sql.autoBroadcastJoinThreshold`` and AQE splits skewed join partitions.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.casts import try_cast_ums
from ..functions.text import build_key, json_path
from ..functions.aggregates import order_struct
from ..model import BEFORE, DELETE, ID, INSERT, SYSTEM_PREFIX, UPDATE
from .conditions import lookup_conditions

#: default for the largest table that a lookup without keys takes: it pairs everything
KEYLESS_ROWS = 10_000


def restrict_to_keys(table: DataFrame, df: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """JON-08: lookup rows whose key occurs in the frame (a left semi join)."""
    keys = df.select(*[F.col(s).alias(f"_k{i}") for i, (s, _) in enumerate(on)])
    cond = [table[lookup] == keys[f"_k{i}"] for i, (_, lookup) in enumerate(on)]
    return table.join(keys, functools.reduce(operator.and_, cond), "left_semi")


def lookup(df: DataFrame, table: DataFrame, on: Sequence[tuple[str, str]], how: str = "inner",
           columns: Mapping[str, str] | Sequence[str] | None = None,
           where: Sequence[tuple] | Column | None = None,
           keyless_rows: int = KEYLESS_ROWS) -> DataFrame:
    """JON-01..08, JON-12, FLT-11: stream columns first, then the looked-up columns.

    ``on`` pairs (frame column, lookup column); any null key part matches nothing:
    inner drops the row, left null-extends it (JON-05).  ``columns`` selects or
    renames lookup columns; a lookup column whose name the frame already has must be
    renamed.  ``where`` filters the lookup before the join.  ``how="right"`` first
    restricts the lookup to the frame's keys (JON-03).  The lookup may be any query
    result, aggregated or distinct (JON-07).

    The join is on the plain key; AQE splits the partition where rows without a key
    gather.  ``on=[]`` pairs every row with every lookup row (JON-06); a lookup of more
    than ``keyless_rows`` rows is refused, never cut.
    """
    if where is not None:
        table = table.filter(where if isinstance(where, Column) else lookup_conditions(where))
    if columns is None:
        have = {c.lower() for c in df.columns}
        picked = {c: c for c in table.columns if c.lower() not in have}
    elif isinstance(columns, Mapping):
        picked = dict(columns)
    else:
        picked = {c: c for c in columns}
    if how == "right" and on:
        table = restrict_to_keys(table, df, on)
    right = table.select(*[F.col(l).alias(f"_l{i}") for i, (_, l) in enumerate(on)],
                         *[F.col(c).alias(a) for c, a in picked.items()])
    if not on:
        if how not in ("inner", "left"):
            raise ValueError("a lookup without keys is inner or left")
        if right.limit(keyless_rows + 1).count() > keyless_rows:
            raise ValueError(f"a lookup without keys takes at most {keyless_rows} rows; "
                             "give join keys or raise keyless_rows")
        return df.join(F.broadcast(right), F.lit(True), how)
    cond = functools.reduce(operator.and_, [F.col(s) == F.col(f"_l{i}")
                                            for i, (s, _) in enumerate(on)])
    return df.join(right, cond, how).select(*df.columns, *picked.values())


def kv_lookup(df: DataFrame, kv: DataFrame, key: str | Column, fields: Mapping[str, tuple[str, str]],
              mode: str = "fields", kv_key: str = "key", kv_value: str = "value",
              order_by: Sequence[str] = ()) -> DataFrame:
    """JON-09..11: left join to a key-value table on a built key, at most one row per key.

    ``key`` is a key expression (STR-01) or Column.  ``fields`` maps output names to
    (source, type): with ``mode="fields"`` a column of the table, with ``"json"`` a
    path in the JSON value, with ``"value"`` the value itself.  Keys stored twice
    count once: the greatest by ``order_by`` (default the value).
    """
    source_columns = sorted({s for s, _ in fields.values()}) if mode == "fields" else [kv_value]
    stored = kv.select(F.col(kv_key).cast("string").alias("_key"),
                       F.struct(*source_columns).alias("_row"),
                       order_struct(order_by or source_columns).alias("_ord")) \
        .groupBy("_key").agg(F.max_by("_row", "_ord").alias("_row"))
    row_key = key if isinstance(key, Column) else build_key(key)
    joined = df.withColumn("_rk", row_key).join(
        stored, F.col("_rk") == F.col("_key"), "left")
    out = []
    for alias, (source, type_name) in fields.items():
        if mode == "fields":
            value = F.col(f"_row.{source}").cast("string")
        elif mode == "json":
            value = json_path(F.col(f"_row.{kv_value}"), source)
        elif mode == "value":
            value = F.col(f"_row.{kv_value}").cast("string")
        else:
            raise ValueError(f"unknown mode {mode!r}")
        out.append(try_cast_ums(value, type_name).alias(alias))
    return joined.select(*df.columns, *out)


#: pairs of key and time bucket with more left rows than this are spread over several tasks
HOT_ROWS = 100_000
SALTS = 16


def stream_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]],
                retention_seconds: int, how: str = "inner", left_ts: str = "ums_ts_",
                right_ts: str = "ums_ts_", columns: Mapping[str, str] | None = None,
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """JON-14: join to a second change stream whose rows are retained for a while.

    Rows of equal keys meet when their event times lie at most ``retention_seconds`` apart,
    on batch frames as on streams; streams need watermarks on both sides.  ``how`` is inner
    or left.

    A batch joins on key and time bucket: buckets are twice the retention wide, a left row is
    in one and a right row in the two it can reach, so rows far apart in time never meet.  A
    bucket of a key with more than ``hot_rows`` left rows (there are at most left rows /
    ``hot_rows`` of those) is dealt into parts of about ``hot_rows`` rows, ``SALTS`` at most, and
    its right rows go to each.  Which ones these are is joined to both sides without a hint, as
    there may be many.  The sides themselves meet in a merge join: the planner does not see the
    copies of right rows, takes that side for small and would gather it in the driver.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"stream_join is inner or left, not {how!r}")
    picked = columns or {c: c for c in right.columns if c not in set(df_low(left))}
    keys = [f"_l{i}" for i in range(len(on))]
    r = right.select(*[F.col(l).alias(k) for k, (_, l) in zip(keys, on)],
                     F.col(right_ts).alias("_rts"), *[F.col(c).alias(a) for c, a in picked.items()])
    interval = F.expr(f"INTERVAL {int(retention_seconds)} SECONDS")
    cond = functools.reduce(operator.and_, [F.col(s) == F.col(k) for k, (s, _) in zip(keys, on)])
    cond = cond & (F.col("_rts") >= F.col(left_ts) - interval) \
        & (F.col("_rts") <= F.col(left_ts) + interval)
    if left.isStreaming or right.isStreaming:
        return left.join(r, cond, how).select(*left.columns, *picked.values())

    width = 2 * max(int(retention_seconds), 1) * 1_000_000

    def bucket(time: Column, shift: int = 0) -> Column:
        return F.floor((F.unix_micros(time.cast("timestamp")) + shift) / width)
    placed = left.withColumn("_bucket", bucket(F.col(left_ts)))
    hot = placed.groupBy(*[F.col(s).alias(f"_h{i}") for i, (s, _) in enumerate(on)],
                         F.col("_bucket").alias("_hb")).count().where(F.col("count") > hot_rows) \
        .select(*[f"_h{i}" for i in range(len(on))], "_hb", F.least(
            F.lit(SALTS), F.ceil(F.col("count") / max(hot_rows, 1))).cast("int").alias("_hot"))

    own = [F.col(f"`{f.name}`") for f in left.schema.fields
           if not isinstance(f.dataType, (T.MapType, T.VariantType))]

    def mark(frame: DataFrame, names: Sequence[str]) -> DataFrame:
        same = [F.col(n) == F.col(f"_h{i}") for i, n in enumerate(names)] + [
            F.col("_bucket") == F.col("_hb")]
        return frame.join(hot, same, "left")
    placed = mark(placed, [s for s, _ in on]).withColumn("_salt", F.coalesce(
        F.pmod(F.xxhash64(*own), F.col("_hot")).cast("int"), F.lit(0)))
    reach = int(retention_seconds) * 1_000_000
    r = r.withColumn("_bucket", F.explode(F.array_distinct(F.array(
        bucket(F.col("_rts"), -reach), bucket(F.col("_rts"), reach)))))
    r = mark(r, keys).withColumn("_rsalt", F.explode(F.sequence(
        F.lit(0), F.coalesce(F.col("_hot"), F.lit(1)) - 1))) \
        .withColumnRenamed("_bucket", "_rb").drop("_hot", "_hb", *[f"_h{i}" for i in range(len(on))])
    meet = cond & (F.col("_bucket") == F.col("_rb")) & (F.col("_salt") == F.col("_rsalt"))
    return placed.join(r.hint("merge"), meet, how).select(*left.columns, *picked.values())


def df_low(df: DataFrame) -> list[str]:
    return [c.lower() for c in df.columns]


def extract_paths(df: DataFrame, json_col: str, paths: Mapping[str, tuple[str, str]],
                  replies: DataFrame | None = None, on: Sequence[tuple[str, str]] = ()
                  ) -> DataFrame:
    """JON-16: typed values at paths of a JSON reply, joined to the rows that asked.

    ``paths`` maps output names to (path such as ``a.b[2].c``, type).  Replies may sit
    in the frame itself or in a table joined on ``on``.
    """
    if replies is not None:
        df = lookup(df, replies, on, "left", columns={json_col: json_col})
    return df.withColumns({name: try_cast_ums(json_path(json_col, path), t)
                           for name, (path, t) in paths.items()}).drop(json_col)


def pair_before_after(df: DataFrame, prefix: str = "ums_b_") -> DataFrame:
    """JON-17: before-images joined to their updates as ``ums_b_*`` columns.

    Inserts and deletes pass with nulls; an update without its before-image (same
    version) is dropped; before-images vanish; system columns are not doubled.
    Before-images are first reduced to one per version, so a version that is
    repeated many times cannot multiply rows.
    """
    value_columns = [c for c in df.columns if not c.startswith(SYSTEM_PREFIX)]
    before = df.filter(F.col("ums_op_") == BEFORE) \
        .groupBy(F.col(ID).alias("_bid")) \
        .agg(F.max(F.struct(*value_columns)).alias("_b"))
    updates = df.filter(F.col("ums_op_") == UPDATE).join(before, F.col(ID) == F.col("_bid")) \
        .select(*df.columns, *[F.col(f"_b.{c}").alias(f"{prefix}{c}") for c in value_columns])
    others = df.filter(F.col("ums_op_").isin(INSERT, DELETE)).select(
        *df.columns, *[F.lit(None).cast(df.schema[c].dataType).alias(f"{prefix}{c}")
                       for c in value_columns])
    return others.unionByName(updates)


def resolve_identity(df: DataFrame, registry: DataFrame, tiers: Sequence[Sequence[tuple[str, str]]],
                     id_col: str, order_by: Sequence[str]) -> DataFrame:
    """JON-18: an id per row by the first usable key tuple, then one row per key tuple.

    ``tiers`` lists (row column, registry column) tuples by priority.  A tier with a
    null part is skipped; the first usable one decides: found gives the registered
    id and version = registered version + 1, not found a new id.  A row without a
    usable tier gets a new id too.  Then, tier by tier, rows whose tier columns are
    all present are reduced to one per combination (the first by ``order_by``), and
    the others fall to the next tier; rows left over pass.  New ids are a hash of
    the row, so a re-run gives the same ids.
    """
    from .changes import dedup

    def usable(tier) -> Column:
        return functools.reduce(operator.and_, [F.col(c).isNotNull() for c, _ in tier])

    new_id = F.md5(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002"))
                                           for c in df.columns]))
    # each row belongs to its first usable tier, so every tier is one branch with one
    # join; the cascade of reductions would take the row to the same tier
    parts = []
    earlier = F.lit(False)
    for i, tier in enumerate(tiers):
        rows = dedup(df.filter(usable(tier) & ~earlier), [c for c, _ in tier], order_by)
        earlier = earlier | usable(tier)
        # one registered row per key tuple: the newest
        reg = registry.select(*[F.col(r).alias(f"_r{j}") for j, (_, r) in enumerate(tier)],
                              F.struct(F.col(ID).alias("v"), F.col(id_col).alias("id"))
                              .alias("_one")) \
            .groupBy(*[f"_r{j}" for j in range(len(tier))]).agg(F.max("_one").alias("_reg"))
        cond = [F.col(c) == F.col(f"_r{j}") for j, (c, _) in enumerate(tier)]
        joined = rows.join(reg, functools.reduce(operator.and_, cond), "left")
        found = F.col("_reg").isNotNull()
        parts.append(joined.select(
            *[F.when(found, F.col("_reg.v") + 1).otherwise(F.col(ID)).alias(ID) if c == ID
              else F.col(c) for c in df.columns],
            F.when(found, F.col("_reg.id")).otherwise(new_id).alias(id_col)))
    parts.append(df.filter(~earlier).withColumn(id_col, new_id))
    return functools.reduce(DataFrame.unionByName, parts)
