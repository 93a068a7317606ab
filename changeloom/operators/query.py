"""Table queries: select, filter, group, having, order and limit (PRJ-13, FLT-12, AGG-01..04, SRT-*)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def _column(c: str | Column) -> Column:
    return F.expr(c) if isinstance(c, str) else c


def query(df: DataFrame, select: Sequence[str | Column] = (), where: str | Column | None = None,
          group_by: Sequence[str] = (), aggs: Mapping[str, str | Column] | None = None,
          having: str | Column | None = None, order_by: Sequence[str | Column] = (),
          distinct: bool = False, limit: int | None = None, max_rows: int | None = None
          ) -> DataFrame:
    """One declarative query over a frame; expressions are Spark SQL text or Columns.

    ``aggs`` maps output names to aggregate expressions, so select-list arithmetic
    over aggregates (``sum(a) / 1000``) works.  ``having`` may use group columns and
    aggregate names.  The row count is the smaller of ``limit`` and ``max_rows``.
    """
    if distinct and (group_by or aggs):
        raise ValueError("distinct and group by exclude each other")
    if having is not None and not aggs:
        raise ValueError("having needs aggregates")
    if where is not None:
        df = df.filter(where)
    if aggs or group_by:
        named = [_column(c).alias(n) for n, c in (aggs or {}).items()]
        if group_by:
            df = df.groupBy(*group_by).agg(*named) if named else df.select(*group_by).distinct()
        else:
            df = df.agg(*named)
        if having is not None:
            df = df.filter(having)
        if select:
            df = df.select(*[_column(c) for c in select])
    elif select:
        df = df.select(*[_column(c) for c in select])
    if distinct:
        df = df.distinct()
    if order_by:
        df = df.orderBy(*[_order(c) for c in order_by])
    rows = [n for n in (limit, max_rows) if n is not None]
    return df.limit(min(rows)) if rows else df


def _order(c: str | Column) -> Column:
    if isinstance(c, Column):
        return c
    name, _, direction = c.strip().partition(" ")
    return F.col(name).desc() if direction.strip().lower() == "desc" else F.col(name).asc()


def top_k(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column], k: int
          ) -> DataFrame:
    """SRT-03: the first ``k`` rows per key.

    Spark cuts each task's rows to ``k`` per key before the shuffle, so a key that
    holds a large share of the table does not reach one task whole.
    """
    w = Window.partitionBy(*keys).orderBy(*[_order(c) for c in order_by])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")
