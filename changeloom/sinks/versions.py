"""A durable table of changes in parquet: buckets, versions and a pointer (CDC-06, SNK-01)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from ..operators.changes import apply_changes, merge_latest, to_target

BUCKET, VERSION, TRY = "_bucket", "_version", "_try"
_POINTER = f"{BUCKET} int, {VERSION} long, {TRY} string, _pointer string"


class VersionedTable:
    """One row per key, kept as ``buckets`` folders of parquet with a version each.

    A batch reads and rewrites only the buckets that its keys fall into, under its own
    number; then the list of current versions, one small row per bucket, is written as
    that batch's pointer.  Readers follow the newest pointer, so they see a batch whole or
    not at all.  Every try of a batch writes files and a pointer of its own: a batch that is
    given again starts from the pointer before it and overwrites nothing that a reader of
    the first try may be reading.  ``path`` must be a folder that every executor reaches.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path, list(keys), buckets

    def upsert(self, changes: DataFrame, batch_id: int) -> None:
        """Apply a batch of changes, numbered from 0 without gaps."""
        new = merge_latest(changes, self.keys)
        self.rewrite(new, batch_id, lambda stored: to_target(new, self.keys) if stored is None
                     else apply_changes(stored, new, self.keys))

    def rewrite(self, new: DataFrame, batch_id: int,
                build: Callable[[DataFrame | None], DataFrame]) -> DataFrame | None:
        """Replace the buckets that the keys of ``new`` fall into by ``build(their rows)``,
        which gets ``None`` where nothing is stored yet and keeps a row of each key of ``new``.

        Returns the rows that were stored in these buckets before.
        """
        # at most ``buckets`` rows
        touched = {r[BUCKET] for r in new.select(self._bucket().alias(BUCKET)).distinct().collect()}
        before = {r[BUCKET]: r for r in self._entries(batch_id - 1)}
        stored = self._read([r for b, r in before.items() if b in touched])
        this = uuid.uuid4().hex
        if touched:
            build(stored).withColumns({BUCKET: self._bucket(), VERSION: F.lit(batch_id)}) \
                .repartition(BUCKET).write.partitionBy(BUCKET, VERSION) \
                .parquet(f"{self.path}/data/{this}")
        kept = [(b, r[VERSION], r[TRY]) for b, r in before.items() if b not in touched]
        now = kept + [(b, batch_id, this) for b in touched]
        new.sparkSession.createDataFrame(
            [(*row, this) for row in sorted(now)], _POINTER) \
            .coalesce(1).write.parquet(f"{self.path}/pointer/n={batch_id}/{this}")
        return stored

    def read(self, batch_id: int | None = None) -> DataFrame:
        """The table after a batch, the newest one by default."""
        if batch_id is None:
            pointers = self.spark.read \
                .option("basePath", f"{self.path}/pointer").parquet(f"{self.path}/pointer/n=*/*")
            batch_id = pointers.agg(F.max("n")).first()[0]
        return self._read(self._entries(batch_id))

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _entries(self, batch_id: int) -> list[Row]:
        """Bucket, version and try of each bucket; of several tries' pointers one counts."""
        try:
            rows = self.spark.read.schema(_POINTER) \
                .parquet(f"{self.path}/pointer/n={batch_id}/*").collect()
        except AnalysisException:
            if batch_id >= 0:
                raise
            return []
        first = min((r["_pointer"] for r in rows), default=None)
        return [r for r in rows if r["_pointer"] == first]

    def _pointer(self, batch_id: int) -> dict[int, int]:
        return {r[BUCKET]: r[VERSION] for r in self._entries(batch_id)}

    def _read(self, entries: Sequence[Row]) -> DataFrame | None:
        if not entries:
            return None
        return self.spark.read.parquet(*[
            f"{self.path}/data/{r[TRY]}/{BUCKET}={r[BUCKET]}/{VERSION}={r[VERSION]}"
            for r in sorted(entries, key=lambda r: r[BUCKET])])
