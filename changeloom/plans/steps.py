"""Ordered steps over a frame (PRJ-02)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from ..operators.lookups import lookup, stream_join
from ..operators.projections import sql_step
from ..operators.sets import union_lookup
from ..patterns import PatternSpec, match_pattern
from .registry import apply_transform

#: a lookup table: a frame, or a function of the session (read when the step runs)
Table = DataFrame | Callable[..., DataFrame | None]


@dataclass(frozen=True)
class SqlStep:
    """A SELECT over the current frame under the flow's table name."""

    sql: str
    tables: Mapping[str, DataFrame] | None = None


@dataclass(frozen=True)
class LookupStep:
    """A lookup join; a table that is not ready leaves the frame as it is."""

    table: Table
    on: Sequence[tuple[str, str]]
    how: str = "inner"
    columns: Any = None
    where: Any = None


@dataclass(frozen=True)
class UnionStep:
    """A union with lookup rows."""

    table: Table
    on: Sequence[tuple[str, str]]
    constants: Mapping[str, Any] | None = None
    missing: str = "zero"


@dataclass(frozen=True)
class StreamJoinStep:
    """A join to a retained second stream."""

    table: Table
    on: Sequence[tuple[str, str]]
    retention_seconds: int
    how: str = "inner"


@dataclass(frozen=True)
class PatternStep:
    """Pattern matching."""

    spec: PatternSpec
    order_by: Sequence[str] = ("ums_ts_", "ums_id_")


@dataclass(frozen=True)
class CustomStep:
    """A registered transform, or any DataFrame -> DataFrame function."""

    transform: str | Callable[[DataFrame], DataFrame]
    param: str | None = None


def _table(table: Table, df: DataFrame) -> DataFrame | None:
    return table if table is None or isinstance(table, DataFrame) else table(df.sparkSession)


def run_step(df: DataFrame, step: Any, table_name: str, spec: Any = None,
             carry: Sequence[str] = ()) -> DataFrame:
    if isinstance(step, SqlStep):
        return sql_step(df, step.sql, table_name, step.tables, carry)
    if isinstance(step, PatternStep):
        if df.isStreaming:
            from ..streaming.state import match_pattern_stream
            return match_pattern_stream(df, step.spec, step.order_by)
        return match_pattern(df, step.spec, step.order_by)
    if isinstance(step, CustomStep):
        return apply_transform(df, step.transform, spec, step.param) \
            if isinstance(step.transform, str) else df.transform(step.transform)
    if isinstance(step, (LookupStep, UnionStep, StreamJoinStep)):
        table = _table(step.table, df)
        if table is None:
            return df
        if isinstance(step, LookupStep):
            return lookup(df, table, step.on, step.how, step.columns, step.where)
        if isinstance(step, UnionStep):
            return union_lookup(df, table, step.on, step.constants, step.missing)
        return stream_join(df, table, step.on, step.retention_seconds, step.how)
    raise ValueError(f"unknown step {step!r}")


def run_steps(df: DataFrame, steps: Sequence[Any], table_name: str = "df", spec: Any = None,
              carry: Sequence[str] = ()) -> DataFrame:
    """PRJ-02: fold the steps over the frame; each sees the output of the one before.

    The result is one lazy plan: nothing is cached or run between steps.  ``carry``: columns
    that SQL steps keep though they do not list them (PRJ-03).
    """
    for step in steps:
        df = run_step(df, step, table_name, spec, carry)
    return df
