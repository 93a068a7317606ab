"""A durable table of changes whose layout the planner knows (CDC-06, SNK-01).

Every version is a bucketed and sorted parquet table.  An upsert joins the stored side bucket
by bucket where it lies: the one exchange of the plan is that of the batch, which is dealt into
the same buckets.  The result of the join lies in buckets already and is written as it is.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.changes import apply_changes, to_target

PARTITIONS = "spark.sql.shuffle.partitions"

#: rows of a bucket above which the next batch writes twice as many buckets
BUCKET_ROWS = 4_000_000
#: buckets that rows are split into at most: each is a task and a file of every batch
MAX_BUCKETS = 512
_POINTER = "folder string, buckets int, rows long, schema string"


@dataclass(frozen=True)
class Layout:
    """One version: its folder, bucket count, rows and columns."""

    folder: str
    buckets: int
    rows: int
    schema: str


@contextmanager
def partitions(spark: SparkSession, n: int) -> Iterator[None]:
    """Plans made inside deal their rows into ``n`` partitions."""
    before = spark.conf.get(PARTITIONS)
    spark.conf.set(PARTITIONS, str(n))
    try:
        yield
    finally:
        spark.conf.set(PARTITIONS, before)


class BucketedTable:
    """One row per key; every batch reads the version before it and writes a new one.

    ``path`` must be a folder that every executor reaches.  A try of a batch writes into a
    folder of its own, and a version counts once its pointer, one row, stands beside those of the
    other batches; so a reader sees a batch whole or not at all, and a batch that is given
    again goes from the version before it and disturbs no reader of the first try.

    Buckets split by doubling: where the stored rows outgrow ``bucket_rows`` a bucket, the
    batch writes twice as many.  A key's hash modulo 2n is its hash modulo n or n more,
    so each task writes its bucket as two and nothing is shuffled for it.  A split stops short
    of more than ``MAX_BUCKETS``; from there on the buckets grow.

    Each batch writes the whole table, without moving it; for batches that touch few keys
    :class:`changeloom.sinks.versions.VersionedTable` rewrites their buckets alone.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64,
                 bucket_rows: int = BUCKET_ROWS):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self.buckets, self.bucket_rows = buckets, bucket_rows

    def upsert(self, changes: DataFrame, batch_id: int) -> None:
        """Apply a batch of changes, numbered from 0 without gaps."""
        spark = changes.sparkSession
        before = self.layout(batch_id - 1, spark) if batch_id else None
        buckets = before.buckets if before else self.buckets
        with partitions(spark, buckets):
            out = self.after(changes, before)
            while before and before.rows > buckets * self.bucket_rows and 2 * buckets <= MAX_BUCKETS:
                buckets *= 2
            folder = f"{self.path}/data/n={batch_id}-{uuid.uuid4().hex}"
            name = _name()
            out.write.format("parquet").option("path", folder).bucketBy(buckets, *self.keys) \
                .sortBy(*self.keys).saveAsTable(name)
            spark.sql(f"DROP TABLE {name}")
        # parquet footers alone answer a count
        rows = spark.read.schema(out.schema).parquet(folder).count()
        pointer = f"{self.path}/pointer/n={batch_id}/{uuid.uuid4().hex}"
        spark.createDataFrame([(folder, buckets, rows, out.schema.json())], _POINTER) \
            .coalesce(1).write.json(pointer)

    def after(self, changes: DataFrame, before: Layout | None) -> DataFrame:
        """The rows after a batch; plan it inside :func:`partitions` of the stored buckets."""
        if before is None:
            return to_target(changes, self.keys)
        return apply_changes(self._stored(before, changes.sparkSession), changes, self.keys)

    def read(self, batch_id: int | None = None) -> DataFrame:
        """The table after a batch, the newest one by default; joins by key need no exchange."""
        return self._stored(self.layout(batch_id, self.spark), self.spark)

    def layout(self, batch_id: int | None, spark: SparkSession) -> Layout:
        """Where a version lies; of several tries of a batch one is chosen by its name."""
        which = "*" if batch_id is None else batch_id
        found = spark.read.schema(f"{_POINTER}, n long").option("basePath", f"{self.path}/pointer") \
            .json(f"{self.path}/pointer/n={which}/*")
        row = found.orderBy(F.col("n").desc(), "folder").first()
        if row is None:
            raise ValueError(f"no version {which} in {self.path}")
        return Layout(row["folder"], row["buckets"], row["rows"], row["schema"])

    def _stored(self, layout: Layout, spark: SparkSession) -> DataFrame:
        """The version as a table whose buckets and order are known to the planner."""
        name, schema = _name(), T.StructType.fromJson(json.loads(layout.schema))
        columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
        by = ", ".join(map(_quoted, self.keys))
        folder = layout.folder.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) "
                  f"SORTED BY ({by}) INTO {layout.buckets} BUCKETS LOCATION '{folder}'")
        try:
            return spark.table(name)
        finally:
            spark.sql(f"DROP TABLE {name}")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _name() -> str:
    return f"bucketed_{uuid.uuid4().hex}"
