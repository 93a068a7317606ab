"""Condition trees to Columns (FLT-*)."""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.times import parse_ts

TEXT, NUMBER, TIME, LOGIC = "text", "number", "time", "logic"


def kind_of(dt: T.DataType) -> str:
    """The condition kind of a column type."""
    if isinstance(dt, T.BooleanType):
        return LOGIC
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return TIME
    if isinstance(dt, T.NumericType):
        return NUMBER
    return TEXT


def kinds_of(df: DataFrame) -> dict[str, str]:
    return {f.name.lower(): kind_of(f.dataType) for f in df.schema.fields}


def compile_condition(tree: Mapping[str, Any], kinds: Mapping[str, str]) -> Column:
    """FLT-01: a nested ``single`` / ``and`` / ``or`` tree to one Column.

    ``{"operator": "and", "filter": [subtree, ...]}`` or ``{"operator": "single",
    "filter": {"field": f, "function": name, "params": [...]}}``.
    """
    op, body = tree["operator"], tree["filter"]
    if op == "single":
        return _leaf(body, kinds)
    children = [compile_condition(t, kinds) for t in body]
    if op == "and":
        return functools.reduce(operator.and_, children)
    if op == "or":
        return functools.reduce(operator.or_, children)
    raise ValueError(f"unknown operator {op!r}")


def _literal(value: Any, kind: str) -> Column:
    if kind == TIME:
        return F.to_timestamp(F.lit(str(value)))
    if kind == NUMBER:
        return F.lit(float(value) if not isinstance(value, (int, float)) else value)
    return F.lit(str(value))


def _leaf(body: Mapping[str, Any], kinds: Mapping[str, str]) -> Column:
    name, function = body["field"], body["function"]
    params = list(body.get("params") or [])
    kind = kinds.get(name.lower())
    if kind is None:
        raise ValueError(f"unknown field {name!r}")
    c = F.col(name)

    def allow(*allowed: str) -> None:
        if kind not in allowed:
            raise ValueError(f"{function} does not apply to a {kind} field ({name})")

    if function in ("equal", "notEqual"):                          # FLT-02
        allow(TEXT, NUMBER, TIME)
        if kind == TEXT:
            params = [p for p in params if str(p) != ""]
        member = c.isin(*[_literal(p, kind) for p in params])
        return member if function == "equal" else ~member
    if function in ("contain", "notContain"):                      # FLT-03
        allow(TEXT, NUMBER)
        value = _literal(params[0], kind)
        return c == value if function == "contain" else c != value
    if function in ("isSet", "notSet"):                            # FLT-04
        return c.isNotNull() if function == "isSet" else c.isNull()
    if function in ("empty", "notEmpty"):                          # FLT-05
        if kind == TEXT:
            return c == "" if function == "empty" else c != ""
        return c.isNull() if function == "empty" else c.isNotNull()
    if function in ("less", "lteq", "greater", "gteq"):            # FLT-07
        allow(NUMBER, TIME)
        value = _literal(params[0], kind)
        return {"less": c < value, "lteq": c <= value,
                "greater": c > value, "gteq": c >= value}[function]
    if function == "between":                                      # FLT-08
        allow(TIME)
        low, high = (F.to_timestamp(F.lit(f"{p}:00")) for p in params[:2])
        return c.between(low, high)
    if function in ("true", "false"):                              # FLT-09
        allow(LOGIC)
        return c == F.lit(function == "true")
    raise ValueError(f"unknown condition function {function!r}")   # FLT-06


def pattern_condition(tree: Mapping[str, Any], schema: T.StructType) -> Column:
    """FLT-10: event condition of a pattern stage; a null cell makes any test false.

    ``{"operator": "single", "logic": {"field_name", "compare_type", "value"}}`` with
    ``gt lt gteq lteq equiv neq like startwith endwith``, or ``and`` / ``or`` with a
    list of subtrees; ``like`` is containment and texts are compared trimmed.
    """
    op, body = tree["operator"], tree["logic"]
    if op in ("and", "or"):
        parts = [pattern_condition(t, schema) for t in body]
        return functools.reduce(operator.and_ if op == "and" else operator.or_, parts)
    if op != "single":
        raise ValueError(f"unknown operator {op!r}")
    name, test, value = body["field_name"], body["compare_type"], body["value"]
    dt = schema[name].dataType
    c: Column = F.col(name)
    if isinstance(dt, T.StringType):
        c, v = F.trim(c), F.lit(str(value).strip())
    elif kind_of(dt) == TIME:
        v = F.to_timestamp(F.lit(str(value)))
    elif isinstance(dt, T.BooleanType):
        v = F.lit(str(value).lower() == "true")
    else:
        v = F.lit(str(value)).cast(dt)
    if test in ("like", "startwith", "endwith"):
        text = c.cast("string")
        v = F.lit(str(value).strip())
        result = {"like": F.contains(text, v), "startwith": F.startswith(text, v),
                  "endwith": F.endswith(text, v)}[test]
    else:
        tests = {"gt": c > v, "lt": c < v, "gteq": c >= v, "lteq": c <= v,
                 "equiv": c == v, "neq": c != v}
        if test not in tests:
            raise ValueError(f"unknown comparison {test!r}")
        result = tests[test]
    return F.coalesce(result, F.lit(False))


#: constant conditions a lookup may carry
_LOOKUP_TESTS = {"=": operator.eq, ">": operator.gt, ">=": operator.ge, "<": operator.lt,
                 "<=": operator.le}


def lookup_conditions(conditions: Sequence[tuple]) -> Column:
    """FLT-11: ``(field, op, value)`` triples joined by ``and``.

    ``op`` is one of ``= > >= < <= in``, ``is null``, ``is not null`` (no value).
    """
    out: list[Column] = []
    for field, op, *value in conditions:
        c = F.col(field)
        if op == "in":
            out.append(c.isin(*value[0]))
        elif op == "is null":
            out.append(c.isNull())
        elif op == "is not null":
            out.append(c.isNotNull())
        elif op in _LOOKUP_TESTS:
            out.append(_LOOKUP_TESTS[op](c, F.lit(value[0])))
        else:
            raise ValueError(f"unknown lookup condition {op!r}")
    return functools.reduce(operator.and_, out)


def filter_events(df: DataFrame, project: Any, project_col: str, type_col: str,
                  types: Sequence[str] = ("track", "track_signup")) -> DataFrame:
    """FLT-13: rows of one project whose type is an event type."""
    return df.filter((F.col(project_col) == F.lit(project)) & F.col(type_col).isin(*types))


def filter_time(df: DataFrame, start: str | None = None, end: str | None = None,
                ts_col: str = "ums_ts_") -> DataFrame:
    """FLT-14: ``start <= ts <= end``; no start is the epoch, no end is now.

    The bounds are plan constants, so the filter reaches the parquet scan.
    """
    low = parse_ts(F.lit(start)) if start else F.lit("1970-01-01").cast("timestamp")
    high = parse_ts(F.lit(end)) if end else F.current_timestamp()
    return df.filter(F.col(ts_col).between(low, high))
