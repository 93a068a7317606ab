"""Aggregates that run on from batch to batch, by Spark's own operators (STM-07, STM-08).

Both classes are called with each micro-batch and its number and give the rows to write
(``drain(..., through=...)``, or inside a ``foreachBatch`` writer).  What a key had before the
batch is read from a :class:`VersionedTable` and put in front of the batch's rows as ordinary
rows; the frames are those of ``operators.blocks``, so a key of any length is cut into blocks.
A batch that is given again starts from the state that the batch before it left.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..model import ID, TS
from ..operators.blocks import BLOCK_ROWS, merged_parts, over_rows, running_parts
from ..session import cut_lineage
from ..sinks.versions import VersionedTable
from .state import MAX_IDLE_HOURS, agg_fields, spark_agg

_ROWS, _MS, _NEW, _TIE = "_rows", "_ms", "_new", "_tie"


class _Parts:
    """The partial aggregates behind a set of aggregates, and how results are read from them."""

    def __init__(self, df: DataFrame, aggs: Mapping[str, tuple[str, str]]):
        self.aggs, self.fields = list(aggs.values()), agg_fields(df, aggs)
        self.kinds = {_ROWS: "sum"}
        for i, (function, _) in enumerate(self.aggs):
            self.kinds[f"_p{i}"] = {"count": "sum", "avg": "sum"}.get(function, function)
            if function == "avg":
                self.kinds[f"_p{i}n"] = "sum"

    def of_row(self) -> dict[str, Column]:
        """The partial aggregates of one row; first and last values stand in a struct, so that a
        null is a value."""
        one = F.lit(1).cast("long")
        out = {_ROWS: one}
        for i, (function, column) in enumerate(self.aggs):
            value = one if function == "count" else F.col(f"`{column}`")
            if function == "avg":
                value = value.cast("double")
                out[f"_p{i}n"] = F.when(value.isNotNull(), one)
            elif function in ("first", "last"):
                value = F.struct(value.alias("v"))
            out[f"_p{i}"] = value
        return {n: out[n] for n in self.kinds}

    def results(self, parts: Column) -> list[Column]:
        out = []
        for i, ((function, _), field) in enumerate(zip(self.aggs, self.fields)):
            value = parts[f"_p{i}"]
            if function in ("first", "last"):
                value = value["v"]
            elif function == "avg":
                value = value / parts[f"_p{i}n"]
            out.append(value.cast(field.dataType).alias(field.name))
        return out


def _tie(df: DataFrame) -> Column:
    """Settles rows that the given order leaves equal; reads all columns."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields
                        if f.dataType.typeName() not in ("map", "variant")])


class ChangingTotals:
    """STM-07: totals by key as a log of changes.

    Each input row gives the old totals of its key (``message_flag`` false, not for the key's
    first row) and the new ones (true).  ``aggs`` maps names to (count, sum, min, max, avg, first
    or last, column).  Within a batch rows count in the order ``order_by``, nulls first.  ``df``
    is the stream, whose columns are needed; ``path`` a folder for the totals that every
    executor reaches.  A batch rewrites the buckets that its keys fall into.
    """

    def __init__(self, df: DataFrame, path: str, keys: Sequence[str],
                 aggs: Mapping[str, tuple[str, str]], order_by: Sequence[str] = (TS, ID),
                 buckets: int = 64, block_rows: int = BLOCK_ROWS):
        self.keys, self.order_by, self.block_rows = list(keys), list(order_by), block_rows
        self.parts = _Parts(df, aggs)
        self.store = VersionedTable(df.sparkSession, path, keys, buckets)
        self.schema = T.StructType([df.schema[k] for k in keys] + self.parts.fields
                                   + [T.StructField("message_flag", T.BooleanType())])

    def __call__(self, batch: DataFrame, batch_id: int) -> DataFrame:
        # read several times: for the buckets, the cuts of the order, the totals and the log
        rows = cut_lineage(batch.select(
            *self.keys, F.struct(*[c for c in self.order_by], _tie(batch).alias(_TIE)).alias("_at"),
            *[v.alias(n) for n, v in self.parts.of_row().items()]))
        rows = rows.select("*", "_at.*").drop("_at").withColumn(_NEW, F.lit(1))
        order = [_NEW, *[c for c in (*self.order_by, _TIE) if c not in self.keys]]

        def with_stored(stored: DataFrame | None) -> DataFrame:
            return rows if stored is None else rows.unionByName(
                stored.withColumn(_NEW, F.lit(0)), allowMissingColumns=True)

        def totals(stored: DataFrame | None) -> DataFrame:
            return with_stored(stored).groupBy(*self.keys).agg(
                *merged_parts(self.parts.kinds, F.struct(*order)))
        stored = self.store.rewrite(rows, batch_id, totals)
        kept = None if stored is None else stored.select(*self.keys, *self.parts.kinds)
        run = running_parts(with_stored(kept), self.keys, order, self.parts.kinds, "_now",
                            "_before", self.block_rows).filter(F.col(_NEW) == 1)
        changes = F.array_compact(F.array(*[
            F.when(F.col(f"{state}.{_ROWS}") > 0, F.struct(
                *self.parts.results(F.col(state)), F.lit(state == "_now").alias("message_flag")))
            for state in ("_before", "_now")]))
        return run.select(*self.keys, F.explode(changes).alias("_c")).select(*self.keys, "_c.*")


class RunningOver:
    """STM-08: each row with aggregates over its key's rows up to it, in event order.

    ``preceding`` bounds the frame in rows; ``None`` starts at the key's first row.  A row
    comes out once the watermark has passed its millisecond; the watermark is the newest
    time seen so far, the batch itself included, less ``lateness`` seconds.  Rows that come
    later than that are left out; rows without a time come out with the batch that brings
    them.  A key is forgotten once the watermark is ``idle_hours`` past its last row.
    ``order_by`` starts with the event time; equal rows are settled by all their columns.
    """

    def __init__(self, df: DataFrame, path: str, keys: Sequence[str],
                 aggs: Mapping[str, tuple[str, str]], preceding: int | None = None,
                 lateness: float = 0, order_by: Sequence[str] = (TS, ID),
                 idle_hours: float = MAX_IDLE_HOURS, buckets: int = 64,
                 block_rows: int = BLOCK_ROWS):
        self.spark, self.path = df.sparkSession, path.rstrip("/")
        self.keys, self.order_by, self.block_rows = list(keys), list(order_by), block_rows
        self.preceding, self.lateness_ms = preceding, int(lateness * 1000)
        self.idle_ms, self.columns, self.aggs = int(idle_hours * 3_600_000), df.columns, dict(aggs)
        self.parts = _Parts(df, aggs)
        self.input = df.schema
        self.store = VersionedTable(self.spark, f"{self.path}/kept", keys, buckets)
        self.schema = T.StructType(df.schema.fields + self.parts.fields)

    def __call__(self, batch: DataFrame, batch_id: int) -> DataFrame:
        waiting, passed = self._before(batch, batch_id)
        time = F.unix_millis(F.col(f"`{self.order_by[0]}`").cast("timestamp"))
        new = batch.withColumns({_MS: time, _TIE: _tie(batch)})
        if passed is not None:
            new = new.filter(F.col(_MS).isNull() | (F.col(_MS) + 1 > passed))
        new = cut_lineage(new)
        newest = new.agg(F.max(_MS)).first()[0]
        now = passed if newest is None else max(newest - self.lateness_ms,
                                                newest - self.lateness_ms if passed is None else passed)
        rows = new if waiting is None else new.unionByName(waiting)
        is_due = F.col(_MS).isNull() if now is None else \
            F.col(_MS).isNull() | (F.col(_MS) + 1 <= now)
        due = rows.filter(is_due)
        folder = f"{self.path}/waiting/n={batch_id}/{uuid.uuid4().hex}"
        rows.filter(~is_due).write.parquet(f"{folder}/rows")
        keep, run = self._rows if self.preceding is not None else self._totals
        kept = self.store.rewrite(due, batch_id,
                                  lambda stored: keep(due, self._alive(stored, passed)))
        # the pointer last: a batch counts once its state is whole
        self.spark.createDataFrame([(folder, now)], "folder string, passed long") \
            .coalesce(1).write.json(f"{self.path}/pointer/n={batch_id}/{uuid.uuid4().hex}")
        return run(due, self._alive(kept, passed))

    def _before(self, batch: DataFrame, batch_id: int) -> tuple[DataFrame | None, int | None]:
        """Waiting rows and watermark after the batch before this one."""
        if batch_id == 0:
            return None, None
        row = self.spark.read.schema("folder string, passed long") \
            .json(f"{self.path}/pointer/n={batch_id - 1}/*").orderBy("folder").first()
        schema = T.StructType([*batch.schema.fields, T.StructField(_MS, T.LongType()),
                               T.StructField(_TIE, T.LongType())])
        return self.spark.read.schema(schema).parquet(f"{row['folder']}/rows"), row["passed"]

    def _alive(self, stored: DataFrame | None, passed: int | None) -> DataFrame | None:
        if stored is None or passed is None:
            return stored
        last = F.max(_MS).over(Window.partitionBy(*self.keys))
        return stored.withColumn("_last", last) \
            .filter(F.col("_last").isNull() | (F.col("_last") + 1 + self.idle_ms > passed)).drop("_last")

    def _order(self) -> list[str]:
        return [*self.order_by, _TIE]

    @property
    def _rows(self):
        """Bounded frames: the last rows of each key are kept."""
        def together(due: DataFrame, stored: DataFrame | None) -> DataFrame:
            due = due.withColumn(_NEW, F.lit(1))
            return due if stored is None else due.unionByName(
                stored.select(*due.drop(_NEW).columns).withColumn(_NEW, F.lit(0)))

        def keep(due: DataFrame, stored: DataFrame | None) -> DataFrame:
            back = Window.partitionBy(*self.keys).orderBy(*[F.col(c).desc() for c in self._order()])
            return together(due, stored).withColumn("_rn", F.row_number().over(back)) \
                .filter(F.col("_rn") <= max(self.preceding, 1)).drop("_rn", _NEW)

        def run(due: DataFrame, stored: DataFrame | None) -> DataFrame:
            aggs = {a: spark_agg(due, f, c) for a, (f, c) in self.aggs.items()}
            out = over_rows(together(due, stored), self.keys, [_NEW, *self._order()],
                            self.preceding, aggs, self.block_rows).filter(F.col(_NEW) == 1)
            return out.select(*[F.col(f"`{c}`") for c in self.columns], *[
                F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.parts.fields])
        return keep, run

    @property
    def _totals(self):
        """Frames from the first row: partial aggregates of each key are kept."""
        kinds = {**self.parts.kinds, _MS: "max"}

        def together(due: DataFrame, stored: DataFrame | None) -> DataFrame:
            due = due.withColumns({**self.parts.of_row(), _NEW: F.lit(1)})
            return due if stored is None else due.unionByName(
                stored.select(*self.keys, *kinds).withColumn(_NEW, F.lit(0)),
                allowMissingColumns=True)

        def keep(due: DataFrame, stored: DataFrame | None) -> DataFrame:
            return together(due, stored).groupBy(*self.keys).agg(
                *merged_parts(kinds, F.struct(_NEW, *self._order())))

        def run(due: DataFrame, stored: DataFrame | None) -> DataFrame:
            out = running_parts(together(due, stored), self.keys, [_NEW, *self._order()],
                                self.parts.kinds, "_now", block_rows=self.block_rows)
            return out.filter(F.col(_NEW) == 1).select(
                *[F.col(f"`{c}`") for c in self.columns], *self.parts.results(F.col("_now")))
        return keep, run
