"""Casts by declared type and default filling (CST-*)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..model import DECIMAL, SPARK_TYPES
from .times import _col, parse_ts, to_epoch_ms


def cast_ums(col: Column | str, type_name: str) -> Column:
    """CST-01: strict cast of text to a declared type; a bad value raises under ANSI mode."""
    c = _col(col)
    if type_name == "binary":
        return F.unbase64(c)
    if type_name in ("datetime", "date"):
        ts = F.coalesce(parse_ts(c), F.to_timestamp(c))
        return ts.cast("date") if type_name == "date" else ts
    return c.cast(SPARK_TYPES[type_name])


def try_cast_ums(col: Column | str, type_name: str) -> Column:
    """CST-02: the same, but a value that does not parse becomes null."""
    c = _col(col)
    if type_name == "binary":
        return F.try_to_binary(c, F.lit("base64"))
    if type_name == "datetime":
        return parse_ts(c)
    if type_name == "date":
        return parse_ts(c).cast("date")
    return c.try_cast(SPARK_TYPES[type_name])


#: property kind -> value used when the property is absent or does not convert
PROPERTY_DEFAULTS = {"number": 0, "string": "", "list": "", "date": 0, "datetime": 0, "bool": 0}


def convert_property(col: Column | str, kind: str) -> Column:
    """CST-03: an event property as text, converted by kind, with the kind's default.

    number -> thousandths as long, string -> text, list (JSON array text) -> comma
    text, date/datetime -> epoch milliseconds, bool -> 1/0.
    """
    c = _col(col)
    if kind == "number":
        value = scale_number(c.try_cast(T.DecimalType(30, 10)))
    elif kind == "string":
        value = c.cast("string")
    elif kind == "list":
        items = F.from_json(c, T.ArrayType(T.StringType()))
        value = F.when(F.size(items) >= 0, _joined(items)).otherwise(c)
    elif kind in ("date", "datetime"):
        value = to_epoch_ms(parse_ts(c))
    elif kind == "bool":
        text = F.lower(c.cast("string"))
        value = F.when(text.isin("true", "false"), (text == "true").cast("int")) \
            .otherwise((text.try_cast("long") != 0).cast("int"))
    else:
        raise ValueError(f"unknown property kind {kind!r}")
    return F.coalesce(value, F.lit(PROPERTY_DEFAULTS[kind]))


def _joined(items: Column) -> Column:
    from .text import join_list
    return join_list(items)


def scale_number(col: Column | str) -> Column:
    """MTH-02: thousandths as long, truncated; exact, not through binary floating point."""
    c = _col(col)
    return F.try_multiply(c.cast(T.DecimalType(30, 10)), F.lit(1000)).cast("long")


def decimal_text(col: Column | str, strip: bool = True) -> Column:
    """CST-04: decimal as text without exponent; trailing zeros stripped for keys."""
    text = _col(col).cast(DECIMAL).cast("string")
    # a value below 1e-6 prints with an exponent when it is cast; format_number does not
    plain = F.when(text.contains("E"), F.translate(F.format_number(_col(col).cast(DECIMAL), 18),
                                                   ",", "")).otherwise(text)
    if not strip:
        return plain
    return F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")


#: type -> SQL literal put in place of a missing value
_ZERO_DATE = "1970-01-01"


def default_for(dt: T.DataType) -> Column:
    if isinstance(dt, T.StringType):
        return F.lit("")
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit(_ZERO_DATE).cast(dt)
    if isinstance(dt, T.NumericType):
        return F.lit(0).cast(dt)
    if isinstance(dt, T.BooleanType):
        return F.lit(False)
    return F.lit(None).cast(dt)


def fill_defaults(df: DataFrame, overrides: Mapping[str, Column] | None = None) -> DataFrame:
    """CST-05: replace every null by its type's default ("" / 0 / zero date)."""
    overrides = overrides or {}
    return df.select(*[
        F.coalesce(F.col(f"`{f.name}`"), overrides.get(f.name, default_for(f.dataType)))
        .alias(f.name) for f in df.schema.fields])
