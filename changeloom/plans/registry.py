"""User functions: scalar, aggregate and transform hooks (UDX-*)."""

from __future__ import annotations

import inspect
import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import aggregates, text
from ..model import SPARK_TYPES

#: rows of a group that a registered aggregate turns into Python values at once
SLICE_ROWS = 65_536

TRANSFORMS: dict[str, Callable[..., DataFrame]] = {}


def return_type(name: str | T.DataType) -> T.DataType:
    """The Spark type of a declared return type; ``timestamp`` too; unknown is binary."""
    if isinstance(name, T.DataType):
        return name
    return {**SPARK_TYPES, "timestamp": T.TimestampType()}.get(name.lower(), T.BinaryType())


def register_udf(spark: SparkSession, name: str, fn: Callable, returns: str | T.DataType,
                 vectorized: bool = False):
    """UDX-01, UDX-02: a scalar function callable by name in any SQL step.

    ``vectorized`` functions take and return pandas Series; others run per row over
    Arrow batches.  Registering a name again replaces it.
    """
    dt = return_type(returns)

    def series(*args: pd.Series) -> pd.Series:
        return fn(*args)

    series.__annotations__ = {"args": pd.Series, "return": pd.Series}
    udf = F.pandas_udf(series, dt) if vectorized else F.udf(fn, dt, useArrow=True)
    return spark.udf.register(name, udf)


class Udaf:
    """UDX-03: base of user aggregates.

    ``create_accumulator``, ``accumulate(acc, *values)`` and ``get_value(acc)`` are
    needed; ``merge(acc, other)`` lets groups be aggregated in parts.  Accumulators
    must pickle.
    """

    return_type: str | T.DataType = "double"

    def create_accumulator(self) -> Any:
        raise NotImplementedError

    def accumulate(self, acc: Any, *values: Any) -> Any:
        raise NotImplementedError

    def get_value(self, acc: Any) -> Any:
        raise NotImplementedError


def register_udaf(spark: SparkSession, name: str, cls: type[Udaf]):
    """UDX-03: an aggregate callable by name in any SQL step.

    A group's argument columns reach one task as Series: for keys that hold much of
    the data use :func:`aggregate_udaf`.
    """
    def run(columns: Sequence[pd.Series]) -> Any:
        agg = cls()
        acc = agg.create_accumulator()
        # a slice at a time: as Python objects values take several times the room of a Series
        for start in range(0, len(columns[0]) if columns else 0, SLICE_ROWS):
            for values in zip(*[c.iloc[start:start + SLICE_ROWS].tolist() for c in columns]):
                acc = agg.accumulate(acc, *values)
        return agg.get_value(acc)

    def fn(*columns: pd.Series) -> Any:
        return run(columns)

    # a grouped-aggregate UDF has one Series argument per value
    names = [f"c{i}" for i in range(len(inspect.signature(cls.accumulate).parameters) - 2)]
    fn.__annotations__ = {**{n: pd.Series for n in names}, "return": float}
    fn.__signature__ = inspect.Signature(
        [inspect.Parameter(n, inspect.Parameter.POSITIONAL_OR_KEYWORD, annotation=pd.Series)
         for n in names], return_annotation=float)
    return spark.udf.register(name, F.pandas_udf(fn, return_type(cls.return_type)))


def aggregate_udaf(df: DataFrame, keys: Sequence[str], cls: type[Udaf], columns: Sequence[str],
                   alias: str, salts: int = 32) -> DataFrame:
    """UDX-03: a mergeable user aggregate in parts, for groups of any size.

    Each Arrow batch is accumulated per key where it is read, partial accumulators
    are merged per (key, salt), and those per key.
    """
    if not hasattr(cls, "merge"):
        raise ValueError("aggregating in parts needs merge()")
    key_fields = [df.schema[k] for k in keys]
    names = list(keys)
    partial_schema = T.StructType([*key_fields, T.StructField("_salt", T.IntegerType()),
                                   T.StructField("_acc", T.BinaryType())])
    final_schema = T.StructType([*key_fields, T.StructField(alias, return_type(cls.return_type))])

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        agg = cls()
        for b, pdf in enumerate(batches):
            rows = []
            for key, group in pdf.groupby(names, dropna=False, sort=False):
                acc = agg.create_accumulator()
                for values in zip(*[group[c].tolist() for c in columns]):
                    acc = agg.accumulate(acc, *values)
                rows.append((*key, b % salts, pickle.dumps(acc)))
            if rows:
                yield pd.DataFrame(rows, columns=partial_schema.names)

    def fold(batches: Iterator[pd.DataFrame]) -> Any:
        agg = cls()
        acc = agg.create_accumulator()
        for pdf in batches:
            for blob in pdf["_acc"]:
                acc = agg.merge(acc, pickle.loads(blob))
        return acc

    def merge(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([(*key, pickle.dumps(fold(batches)))], columns=partial_schema.names)

    def finish(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([(*key, cls().get_value(fold(batches)))], columns=final_schema.names)

    return df.select(*keys, *[c for c in columns if c not in keys]) \
        .mapInPandas(part, partial_schema) \
        .groupBy(*keys, "_salt").applyInPandas(merge, partial_schema) \
        .groupBy(*keys).applyInPandas(finish, final_schema)


def register_transform(name: str, fn: Callable[..., DataFrame] | None = None):
    """UDX-04: register ``fn(spark, df, spec, param)`` -> DataFrame; a decorator too."""
    if fn is None:
        return lambda f: register_transform(name, f)
    TRANSFORMS[name] = fn
    return fn


def apply_transform(df: DataFrame, name: str, spec: Any = None, param: str | None = None
                    ) -> DataFrame:
    """UDX-04: call a registered transform."""
    if name not in TRANSFORMS:
        raise ValueError(f"no transform {name!r}")
    return TRANSFORMS[name](df.sparkSession, df, spec, param)


#: UDX-05: Column builders available by name without registration
BUILT_IN = {
    "firstValue": aggregates.first_value,
    "lastValue": aggregates.last_value,
    "adjacentSub": aggregates.adjacent_sub,
    "mapToString": text.map_to_string,
}
