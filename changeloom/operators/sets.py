"""Unions with lookup rows (SET-01, SET-02)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, functions as F, types as T

from ..model import INSERT, OP
from .lookups import restrict_to_keys


def union_lookup(df: DataFrame, table: DataFrame, on: Sequence[tuple[str, str]],
                 constants: Mapping[str, Any] | None = None, missing: str = "zero") -> DataFrame:
    """SET-01, SET-02: append the lookup rows whose keys occur in the frame.

    Lookup columns are matched by name (lower case) and cast to the frame's types;
    extra ones are dropped; ``constants`` become columns.  Missing columns are 0 for
    numbers and null otherwise (``missing="null"``: null for all); a missing
    operation is an insert.  Duplicates stay.
    """
    rows = restrict_to_keys(table, df, on)
    have = {c.lower(): c for c in rows.columns}
    constants = {k.lower(): v for k, v in (constants or {}).items()}
    out = []
    for f in df.schema.fields:
        name = f.name.lower()
        if name in constants:
            c = F.lit(constants[name])
        elif name in have:
            c = F.col(have[name])
        elif name == OP:
            c = F.lit(INSERT)
        elif missing == "zero" and isinstance(f.dataType, T.NumericType):
            c = F.lit(0)
        else:
            c = F.lit(None)
        out.append(c.cast(f.dataType).alias(f.name))
    return df.unionByName(rows.select(*out))
