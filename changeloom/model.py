"""Data model: system columns, declared types, table names and flow specs (§1)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

# Fixed values of the message format.
ID, TS, OP, UID, ACTIVE = "ums_id_", "ums_ts_", "ums_op_", "ums_uid_", "ums_active_"
SYSTEM_PREFIX = "ums_"
SYSTEM_COLUMNS = (TS, ID, OP)
INSERT, UPDATE, DELETE, BEFORE = "i", "u", "d", "b"

# Message classes that carry rows, and those that carry only a time.
INITIAL = "data_initial_data"
INCREMENT = "data_increment_data"
BATCH = "data_batch_data"
HEARTBEAT = "data_increment_heartbeat"
DATA_PROTOCOLS = (INITIAL, INCREMENT, BATCH)
TIME_PROTOCOLS = (HEARTBEAT, "data_increment_termination", "data_batch_termination")

DECIMAL = T.DecimalType(38, 18)

#: declared type name -> Spark type
SPARK_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "datetime": T.TimestampType(),
    "decimal": DECIMAL,
    "binary": T.BinaryType(),
}


def declared_type(dt: T.DataType) -> str:
    """The declared type name of a Spark type (array and struct become JSON types)."""
    if isinstance(dt, T.DecimalType):
        return "decimal"
    if isinstance(dt, T.ArrayType):
        return "jsonarray"
    if isinstance(dt, T.StructType):
        return "jsonobject"
    if isinstance(dt, T.TimestampNTZType):
        return "datetime"
    if isinstance(dt, (T.ShortType, T.ByteType)):
        return "int"
    for name, spark_type in SPARK_TYPES.items():
        if dt == spark_type:
            return name
    raise ValueError(f"no declared type for {dt.simpleString()}")


@dataclass(frozen=True)
class Field:
    """One column of a message schema."""

    name: str
    type: str = "string"
    nullable: bool = True


@dataclass(frozen=True)
class Namespace:
    """Seven-part table name: system.instance.database.table.version.shard.subshard."""

    system: str
    instance: str
    database: str
    table: str
    version: str = "*"
    db_partition: str = "*"
    table_partition: str = "*"

    PARTS = ("system", "instance", "database", "table", "version", "db_partition",
             "table_partition")

    @classmethod
    def parse(cls, text: str) -> "Namespace":
        parts = text.lower().split(".")
        if not 4 <= len(parts) <= 7:
            raise ValueError(f"a table name has four to seven parts: {text!r}")
        return cls(*parts)

    def parts(self) -> list[str]:
        return [getattr(self, p) for p in self.PARTS]

    def __str__(self) -> str:
        return ".".join(self.parts())


@dataclass(frozen=True)
class Validity:
    """Validity gate settings (STM-11); all five belong together."""

    columns: Sequence[str]
    rule: str = "and"
    rule_mode: str = "timeout"
    timeout_seconds: int = 0
    action: str = "drop"


@dataclass
class Sink:
    """Where a flow's rows go: a callable taking (DataFrame, Sink)."""

    writer: Callable[..., Any]
    name: str = "sink"
    keys: Sequence[str] = ()
    mutation: str = "iud"
    output: str = ""
    options: dict[str, Any] = field(default_factory=dict)
    sink_uid: bool = False


@dataclass
class FlowSpec:
    """One flow: source table, steps, validity and sink.

    Rows pass the validity gate after the steps; a sink with keys that does more than
    insert gets the newest row per key.
    """

    source: str
    steps: Sequence[Any] = ()
    sink: Sink | None = None
    fields: Sequence[Field] = ()
    protocols: Sequence[str] = DATA_PROTOCOLS
    validity: Validity | None = None
    name: str = ""

    @property
    def label(self) -> str:
        return self.name or f"{self.source}->{self.sink.name if self.sink else ''}"
