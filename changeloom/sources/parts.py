"""Custom sources and sinks as Spark data sources (SRC-19, SNK-22).

A caller's source names its splits and reads one of them per task; a caller's sink writes one
part per task and makes all parts visible at once, after every task has succeeded.
``PartFiles`` is such a source and sink: Arrow part files behind commit files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import SparkSession, types as T
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo,
                                    Filter, GreaterThan, GreaterThanOrEqual, InputPartition,
                                    LessThan, LessThanOrEqual, WriterCommitMessage)

PUSH_DOWN = "spark.sql.python.filterPushdown.enabled"


class CustomFormat:
    """What a caller writes; a source needs the first three, a sink the last three.

    ``options`` are those of the reader or writer, with names in lower case.  Splits and
    messages must pickle.
    """

    def schema(self, options: Mapping[str, str]) -> T.StructType | str:
        raise NotImplementedError

    def splits(self, options: Mapping[str, str], filters: Sequence[Filter]) -> Sequence[Any]:
        """One entry per task.  ``filters`` may leave splits out; Spark applies them again."""
        raise NotImplementedError

    def read(self, split: Any, options: Mapping[str, str]) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def write(self, batches: Iterator[pa.RecordBatch], options: Mapping[str, str]) -> Any:
        """Write a task's rows where no reader sees them; the result goes to ``commit``."""
        raise NotImplementedError

    def commit(self, messages: Sequence[Any], options: Mapping[str, str], overwrite: bool) -> None:
        """Make all parts visible."""
        raise NotImplementedError

    def abort(self, messages: Sequence[Any], options: Mapping[str, str]) -> None:
        """Drop the parts of the tasks that had succeeded."""


class _Split(InputPartition):
    def __init__(self, value: Any):
        super().__init__(value)


class _Message(WriterCommitMessage):
    def __init__(self, value: Any):
        self.value = value


class _Reader(DataSourceReader):
    def __init__(self, custom: CustomFormat, options: Mapping[str, str]):
        self.custom, self.options, self.filters = custom, options, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        self.filters = list(filters)
        # all are handed back: they only leave splits out here
        yield from filters

    def partitions(self) -> Sequence[InputPartition]:
        return [_Split(s) for s in self.custom.splits(self.options, self.filters)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        # a frame without splits is read once, without one
        if partition is not None:
            yield from self.custom.read(partition.value, self.options)


class _Writer(DataSourceArrowWriter):
    def __init__(self, custom: CustomFormat, options: Mapping[str, str], overwrite: bool):
        self.custom, self.options, self.overwrite = custom, options, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return _Message(self.custom.write(iterator, self.options))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self.custom.commit([m.value for m in messages if m], self.options, self.overwrite)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.custom.abort([m.value for m in messages if m], self.options)


def register_format(spark: SparkSession, format_name: str, custom: type[CustomFormat]) -> None:
    """SRC-19, SNK-22: ``spark.read.format(format_name)`` and ``df.write.format(format_name)``.

    Filters reach the source, for which the session setting ``PUSH_DOWN`` is switched on.
    """
    def lower(options: Mapping[str, str]) -> dict[str, str]:
        return {k.lower(): v for k, v in options.items()}

    class Format(DataSource):
        @classmethod
        def name(cls) -> str:
            return format_name

        def schema(self) -> T.StructType | str:
            return custom().schema(lower(self.options))

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return _Reader(custom(), lower(self.options))

        def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
            return _Writer(custom(), lower(self.options), overwrite)

    spark.conf.set(PUSH_DOWN, "true")
    spark.dataSource.register(Format)


def _may_hold(low: Any, high: Any, rule: Filter) -> bool:
    """Whether a part with values from ``low`` to ``high`` can have rows for the filter."""
    value = rule.value
    if isinstance(rule, EqualTo):
        return low <= value <= high
    if isinstance(rule, GreaterThan):
        return high > value
    if isinstance(rule, GreaterThanOrEqual):
        return high >= value
    if isinstance(rule, LessThan):
        return low < value
    return low <= value


class PartFiles(CustomFormat):
    """Arrow part files in the folder ``path``, visible once a commit file names them.

    ``path`` is a folder that every executor reaches (a URI or an absolute path).  A commit
    file is moved into place whole, so a reader sees all parts of a job or none; parts of
    failed tasks and jobs are in no commit file.  ``range_column`` (a whole-number column)
    has its least and greatest value kept per part, and filters on it leave parts out.
    """

    @staticmethod
    def _folder(options: Mapping[str, str]) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(options["path"])

    def _commits(self, options: Mapping[str, str]) -> list[dict]:
        store, path = self._folder(options)
        found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
        commits = []
        for info in sorted(found, key=lambda i: i.path):
            if info.base_name.startswith("commit-"):
                with store.open_input_stream(info.path) as f:
                    commits.append(json.loads(f.read()))
        # an overwriting commit hides those that it has seen
        hidden = {name for c in commits for name in c["replaces"]}
        return [c for c in commits if c["name"] not in hidden]

    def schema(self, options):
        commits = self._commits(options)
        if not commits:
            raise ValueError(f"no committed rows under {options['path']}")
        return T.StructType.fromJson(commits[-1]["schema"])

    def splits(self, options, filters):
        column = options.get("range_column")
        rules = [f for f in filters if getattr(f, "attribute", None) == (column,) and isinstance(
            f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual))]
        return [p["file"] for c in self._commits(options) for p in c["parts"]
                if not rules or (p["column"] != column
                                 or p["low"] is not None
                                 and all(_may_hold(p["low"], p["high"], r) for r in rules))]

    def read(self, split, options):
        store, path = self._folder(options)
        with store.open_input_file(f"{path}/{split}") as f, pa.ipc.open_file(f) as parts:
            for i in range(parts.num_record_batches):
                yield parts.get_batch(i)

    def write(self, batches, options):
        from pyspark.sql.pandas.types import from_arrow_schema
        store, path = self._folder(options)
        store.create_dir(path, recursive=True)
        column, low, high, schema, writer = options.get("range_column"), None, None, None, None
        name = f"part-{uuid.uuid4().hex}.arrow"
        try:
            with store.open_output_stream(f"{path}/{name}") as f:
                for batch in batches:
                    if writer is None:
                        schema = from_arrow_schema(batch.schema).jsonValue()
                        writer = pa.ipc.new_file(f, batch.schema)
                    writer.write_batch(batch)
                    if column:
                        ends = pc.min_max(batch.column(column)).as_py()
                        if ends["min"] is not None:
                            low = ends["min"] if low is None else min(low, ends["min"])
                            high = ends["max"] if high is None else max(high, ends["max"])
                if writer is not None:
                    writer.close()
        except BaseException:
            store.delete_file(f"{path}/{name}")
            raise
        if writer is None:
            store.delete_file(f"{path}/{name}")
            return None
        return {"file": name, "column": column, "low": low, "high": high, "schema": schema}

    def commit(self, messages, options, overwrite):
        parts = [m for m in messages if m]
        store, path = self._folder(options)
        before = self._commits(options) if overwrite else []
        if not parts and not before:
            return
        name = f"commit-{uuid.uuid4().hex}"
        schema = parts[0]["schema"] if parts else before[-1]["schema"]
        text = json.dumps({"name": name, "replaces": [c["name"] for c in before],
                           "schema": schema, "parts": [
                               {k: v for k, v in p.items() if k != "schema"} for p in parts]})
        with store.open_output_stream(f"{path}/new-{name}") as f:
            f.write(text.encode())
        store.move(f"{path}/new-{name}", f"{path}/{name}")

    def abort(self, messages, options):
        store, path = self._folder(options)
        for m in messages:
            if m:
                store.delete_file(f"{path}/{m['file']}")
