"""Rule-driven selects, filters, tagging and column completion (PRJ-06..12)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, functions as F

from ..model import SYSTEM_PREFIX
from .conditions import compile_condition, kinds_of

UNKNOWN = "unknown"


@dataclass(frozen=True)
class Include:
    """PRJ-06: keep these columns."""

    columns: Sequence[str]


@dataclass(frozen=True)
class Exclude:
    """PRJ-07: keep all columns but these (names compare without case)."""

    columns: Sequence[str]


@dataclass(frozen=True)
class Cast:
    """PRJ-08: ``cast(field as type) as alias``."""

    field: str
    type: str
    alias: str


@dataclass(frozen=True)
class Expression:
    """PRJ-09: any SQL expression with an alias."""

    sql: str
    alias: str


@dataclass(frozen=True)
class Where:
    """PRJ-10: a condition tree (FLT-01)."""

    tree: Mapping[str, Any]


def apply_schema_rules(df: DataFrame, rules: Sequence[Any]) -> DataFrame:
    """PRJ-06..10: select rules add output columns, ``Where`` rules filter.

    Output columns keep declaration order; a column named twice appears once.
    Without a select rule all columns stay.
    """
    kinds = kinds_of(df)
    out: dict[str, Any] = {}
    selects = False
    for rule in rules:
        if isinstance(rule, Where):
            df = df.filter(compile_condition(rule.tree, kinds))
            continue
        selects = True
        if isinstance(rule, Include):
            columns = {c: F.col(c) for c in rule.columns}
        elif isinstance(rule, Exclude):
            dropped = {c.lower() for c in rule.columns}
            columns = {c: F.col(c) for c in df.columns if c.lower() not in dropped}
        elif isinstance(rule, Cast):
            columns = {rule.alias: F.col(rule.field).cast(rule.type)}
        elif isinstance(rule, Expression):
            columns = {rule.alias: F.expr(rule.sql)}
        else:
            raise ValueError(f"unknown rule {rule!r}")
        for name, column in columns.items():
            out.setdefault(name, column)
    return df.select(*[c.alias(n) for n, c in out.items()]) if selects else df


def tag_events(df: DataFrame, rules: Sequence[tuple[Mapping[str, Any], Mapping[str, str]]]
               ) -> DataFrame:
    """PRJ-11: tag columns from ``(condition tree, {tag column: value})`` rules.

    The first rule that matches and names the column wins, otherwise ``unknown``.
    """
    kinds = kinds_of(df)
    tags: dict[str, Any] = {}
    for tree, values in rules:
        cond = compile_condition(tree, kinds)
        for name, value in values.items():
            chain = tags.get(name)
            tags[name] = F.when(cond, F.lit(value)) if chain is None \
                else chain.when(cond, F.lit(value))
    return df.withColumns({n: c.otherwise(F.lit(UNKNOWN)) for n, c in tags.items()})


def ensure_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """PRJ-12: add the named columns that are absent as null text; never system columns."""
    have = {c.lower() for c in df.columns}
    missing = [n for n in names
               if n.lower() not in have and not n.lower().startswith(SYSTEM_PREFIX)]
    return df.withColumns({n: F.lit(None).cast("string") for n in missing}) if missing else df
