"""Order-aware aggregates (AGG-05..08, UDX-05).

Grouped forms are plain aggregates with a map-side partial step, so a key that
holds a large share of the rows reaches its reducer as one row per task.  Frame
forms take a Window and need all of a key's rows in order; ``operators.blocks``
splits long keys for bounded frames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .times import _col


def order_struct(order_by: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in order_by])


def first_value(col: Column | str, order_by: Sequence[str]) -> Column:
    """AGG-05: value of the earliest row."""
    return F.min_by(_col(col), order_struct(order_by))


def last_value(col: Column | str, order_by: Sequence[str]) -> Column:
    """AGG-06: value of the latest row."""
    return F.max_by(_col(col), order_struct(order_by))


def adjacent_difference(last: Column, previous: Column) -> Column:
    """Last minus previous; a drop is a counter reset, so the last value itself; 0 for one value."""
    return F.when(previous.isNull(), F.lit(0)).when(last < previous, last) \
        .otherwise(last - previous)


def adjacent_sub(df: DataFrame, keys: Sequence[str], col: str, order_by: Sequence[str],
                 alias: str = "diff") -> DataFrame:
    """AGG-07: counter-aware difference of the two latest values per key.

    The rank filter is applied before the shuffle too (window group limit), so at
    most two rows per key and task are exchanged.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order_by])
    top = df.select(*keys, col, *[c for c in order_by if c not in (col, *keys)]) \
        .filter(F.col(col).isNotNull()) \
        .withColumn("_rn", F.row_number().over(w)).filter("_rn <= 2")
    last = F.max(F.when(F.col("_rn") == 1, F.col(col)))
    previous = F.max(F.when(F.col("_rn") == 2, F.col(col)))
    return top.groupBy(*keys).agg(last.alias("_l"), previous.alias("_p")) \
        .select(*keys, adjacent_difference(F.col("_l"), F.col("_p")).alias(alias))


def weighted_avg(value: Column | str, weight: Column | str) -> Column:
    """AGG-08: integer weighted average, null when the weights sum to 0."""
    v, w = _col(value), _col(weight)
    total, weights = F.sum(v * w), F.sum(w)
    exact = total.cast("decimal(38,0)") / F.nullif(weights, F.lit(0)).cast("decimal(38,0)")
    return F.when(exact >= 0, F.floor(exact)).otherwise(F.ceil(exact)).cast("long")
