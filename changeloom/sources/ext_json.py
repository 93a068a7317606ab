"""User-declared nested JSON to flat typed rows (SRC-03..09, SRC-20)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..model import OP, TS, declared_type
from .messages import _typed

_CORRUPT = "_corrupt"


@dataclass(frozen=True)
class JsonField:
    """One declared field.

    ``type`` is a plain type, ``jsonobject`` or ``jsonarray`` (with ``fields``), a
    plain type followed by ``array``, or ``tuple`` (``fields`` and ``separator``).
    ``codes`` maps source operation codes to i/u/d on the field renamed to the
    operation column.
    """

    name: str
    type: str = "string"
    fields: Sequence["JsonField"] = ()
    separator: str = ""
    rename: str = ""
    codes: Mapping[str, str] | None = None

    @property
    def out(self) -> str:
        return (self.rename or self.name).lower()


def parse_codes(text: str) -> dict[str, str]:
    """SRC-08: ``"i:ins,u:upd,d:del"`` to source code -> i/u/d."""
    return {source.strip(): op.strip() for op, source in
            (pair.split(":", 1) for pair in text.split(","))}


def json_struct(fields: Sequence[JsonField]) -> T.StructType:
    """The Spark schema of a declaration; leaves stay text and are cast later.

    A source field may be declared twice, once as itself and once renamed.
    """
    by_name = {f.name: f for f in reversed(fields)}
    return T.StructType([T.StructField(f.name, _json_type(f)) for f in reversed(by_name.values())])


def _json_type(f: JsonField) -> T.DataType:
    if f.type == "jsonobject":
        return json_struct(f.fields)
    if f.type == "jsonarray":
        return T.ArrayType(json_struct(f.fields))
    if f.type.endswith("array"):
        return T.ArrayType(T.StringType())
    return T.StringType()


def read_ext_json(df: DataFrame, value_col: str, fields: Sequence[JsonField],
                  keep: Sequence[str] = (), bad: str = "drop") -> DataFrame:
    """SRC-03..09: flatten declared JSON to leaf columns in declaration order.

    * a missing object gives null leaves (SRC-03);
    * ``<t>array``: one row per element, one null row when missing, none when empty
      (SRC-04); ``jsonarray``: one row per object, bad message when missing (SRC-05);
      at most one array per declaration;
    * ``tuple``: text split into sub-fields, null text gives nulls, too few parts is
      bad (SRC-06);
    * ``rename`` to the event-time column makes the leaf a datetime of any unit
      (SRC-07, SRC-09); ``codes`` maps operation codes, unmapped is bad (SRC-08).

    ``bad`` is ``drop``, ``only`` or ``flag`` as in ``apply_ums_schema``.
    """
    arrays = _arrays(fields)
    if len(arrays) > 1:
        raise ValueError("only one array per declaration")
    schema = T.StructType(json_struct(fields).fields + [T.StructField(_CORRUPT, T.StringType())])
    # the raw text is needed only to hand bad messages on
    extra = [value_col] if bad == "only" and value_col not in keep else []
    m = df.select(*keep, *extra, F.from_json(
        F.col(value_col), schema, {"columnNameOfCorruptRecord": _CORRUPT}).alias("_m"))
    broken = F.col("_m").isNull() | F.col(f"_m.{_CORRUPT}").isNotNull()
    element_path = ""
    if arrays:
        element_path, array = arrays[0]
        items = F.col(f"_m.{element_path}")
        if array.type == "jsonarray":
            # a missing array keeps one row so that the message can be reported as bad
            missing = F.array(F.lit(None).cast(_json_type(array).elementType))
            m = m.withColumn("_no_array", items.isNull())
            broken = broken | F.col("_no_array")
        else:
            missing = F.array(F.lit(None).cast("string"))
        m = m.withColumn("_e", F.explode(F.coalesce(items, missing)))

    leaves: list[tuple[JsonField, Column]] = []
    checks: list[Column] = []
    _collect(fields, "_m", element_path, leaves, checks)
    raw = []
    columns = []
    for leaf, value in leaves:
        kind = leaf.type
        if leaf.codes is not None:
            mapped = F.lit(None).cast("string")
            for code, op in leaf.codes.items():
                mapped = F.when(value == code, F.lit(op)).otherwise(mapped)
            checks.append(mapped.isNull())
            value = mapped
        if leaf.out == TS:
            kind = "event_time"
        raw.append(value.alias(f"_raw_{leaf.out}"))
        columns.append((leaf.out, f"_raw_{leaf.out}", kind))
    also = broken
    for check in checks:
        also = also | check
    flat = m.select(*keep, *extra, F.coalesce(also, F.lit(False)).alias("_broken"), *raw)
    return _typed(flat, columns, keep, bad, extra=extra, also_bad=F.col("_broken"))


def _arrays(fields: Sequence[JsonField], path: str = "") -> list[tuple[str, JsonField]]:
    found = []
    for f in fields:
        here = f"{path}.`{f.name}`" if path else f"`{f.name}`"
        if f.type == "jsonobject":
            found += _arrays(f.fields, here)
        elif f.type.endswith("array"):
            found.append((here, f))
    return found


def _collect(fields: Sequence[JsonField], base: str, array_path: str,
             leaves: list, checks: list, is_array_item: bool = False) -> None:
    for f in fields:
        path = f"{base}.`{f.name}`"
        if f.type == "jsonobject":
            _collect(f.fields, path, array_path, leaves, checks, is_array_item)
        elif f.type == "jsonarray":
            _collect(f.fields, "_e", array_path, leaves, checks, True)
        elif f.type.endswith("array"):
            leaves.append((JsonField(f.name, f.type.removesuffix("array"), rename=f.rename,
                                     codes=f.codes), F.col("_e")))
        elif f.type == "tuple":
            text = F.col(path)
            parts = F.split(text, re.escape(f.separator), -1)
            checks.append(text.isNotNull() & (F.size(parts) < len(f.fields)))
            for i, part in enumerate(f.fields):
                leaves.append((part, F.get(parts, F.lit(i))))
        else:
            leaves.append((f, F.col(path)))


def infer_ext_schema(df: DataFrame, value_col: str, sampling_ratio: float = 1.0) -> list[JsonField]:
    """SRC-20: propose a declaration from the messages themselves.

    One aggregate in the JVM; only the merged schema reaches the driver.  Texts that are no
    JSON count for nothing; numbers with a point are doubles, fields of mixed types strings.
    """
    texts = df.select(F.col(value_col).cast("string").alias("_text"))
    if sampling_ratio < 1.0:
        texts = texts.sample(sampling_ratio, seed=0)
    merged = texts.agg(F.schema_of_variant_agg(F.try_parse_json("_text"))).first()[0]
    if not merged or not merged.startswith("OBJECT<"):
        return []
    ddl = re.sub(r"\bVOID\b|\bVARIANT\b", "STRING", merged.replace("OBJECT<", "STRUCT<"))
    ddl = re.sub(r"\bDECIMAL\(\d+,\s*\d+\)", "DOUBLE", ddl)
    return _declare(T.StructType.fromDDL(ddl[len("STRUCT<"):-1]))


def _declare(schema: T.StructType) -> list[JsonField]:
    out = []
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            out.append(JsonField(f.name, "jsonobject", tuple(_declare(f.dataType))))
        elif isinstance(f.dataType, T.ArrayType):
            item = f.dataType.elementType
            if isinstance(item, T.StructType):
                out.append(JsonField(f.name, "jsonarray", tuple(_declare(item))))
            else:
                out.append(JsonField(f.name, declared_type(item) + "array"))
        else:
            out.append(JsonField(f.name, declared_type(f.dataType)))
    return out


def operation_field(name: str, codes: str) -> JsonField:
    """Shorthand for the field that carries the operation code."""
    return JsonField(name, "string", rename=OP, codes=parse_codes(codes))
