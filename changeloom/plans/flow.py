"""Flow and job entry points (§3.4)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..model import ID, SYSTEM_COLUMNS, UID, FlowSpec, Namespace, Sink
from ..operators.changes import merge_latest
from ..operators.projections import project_job, project_output
from ..session import cut_lineage
from ..sources.messages import (apply_ums_schema, classify_messages, match_namespace,
                                read_ums)
from ..sources.tables import read_source
from ..sinks.write import SINKS, write_parquet
from .steps import run_steps


def decode(messages: DataFrame, spec: FlowSpec, bad: str = "drop") -> DataFrame:
    """Typed rows of the flow's source out of keyed messages."""
    rows = classify_messages(messages)
    rows = rows.filter(rows["protocol"].isin(*spec.protocols)
                       & match_namespace("namespace", spec.source))
    return apply_ums_schema(read_ums(rows.select("key", "value"), key_col="key"), spec.fields,
                            bad=bad)


def flow_rows(spec: FlowSpec, source: DataFrame) -> DataFrame:
    """Decode (when the frame carries messages) and run the steps.

    SQL steps keep the system columns (PRJ-03) if the source is messages or the sink does
    more than insert; the row identity too if the flow has a validity gate.
    """
    messages = spec.fields and "value" in source.columns and "ums_id_" not in source.columns
    df = decode(source, spec) if messages else source
    carry = []
    if messages or spec.sink is not None and spec.sink.mutation != "i":
        carry = [*SYSTEM_COLUMNS, *[UID for _ in range(spec.validity is not None)]]
    return run_steps(df, spec.steps, Namespace.parse(spec.source).table, spec, carry)


def sink_rows(spec: FlowSpec, rows: DataFrame) -> DataFrame:
    """The rows as the sink takes them: newest per sink key unless it only inserts, projected."""
    if spec.sink is None:
        return rows
    if spec.sink.mutation != "i" and spec.sink.keys and ID in rows.columns:
        rows = merge_latest(rows, list(spec.sink.keys))
    return project_output(rows, spec.sink.output, spec.sink.sink_uid, system=True)


def run_flow(spec: FlowSpec, source: DataFrame,
             rest: Callable[[DataFrame], Any] | None = None) -> DataFrame:
    """Decode, run the steps, keep the rows to send, merge by the sink's keys, project.

    ``rest`` gets the other rows of a validity gate with their ``_fate`` (``hold``, ``alert``
    or ``drop``); a gate without it is an error.  ``flows_writer`` keeps held rows itself.
    """
    if spec.validity is not None and rest is None:
        raise ValueError(f"flow {spec.label!r} has a validity gate; say where the rest goes")
    rows = flow_rows(spec, source)
    if spec.validity is not None:
        from ..streaming.hold import FATE, SEND, validity
        gate = spec.validity
        # decided once: the lookup behind it may change between reads
        rows = cut_lineage(
            validity(rows, gate.columns, gate.rule, gate.timeout_seconds, gate.action))
        rest(rows.filter(F.col(FATE) != SEND))
        rows = rows.filter(F.col(FATE) == SEND).drop(FATE)
    return sink_rows(spec, rows)


@dataclass
class JobSpec:
    """A batch job: source with its range, steps, projection and sink."""

    source: str | DataFrame
    namespace: str = ""
    start: str | None = None
    end: str | None = None
    steps: Sequence[Any] = ()
    projection: str = "*"
    path: str = ""
    mode: str = "overwrite"
    sink: Sink | str | None = None
    max_records: int | None = None
    options: dict[str, Any] = field(default_factory=dict)


def run_job(spark: SparkSession, spec: JobSpec) -> DataFrame:
    """Read, transform, project; write when a path or sink is given."""
    df = spec.source if isinstance(spec.source, DataFrame) else read_source(
        spark, spec.source, spec.start, spec.end, spec.namespace, options=spec.options)
    table = Namespace.parse(spec.namespace).table if spec.namespace else "increment"
    out = project_job(run_steps(df, spec.steps, table, spec), spec.projection)
    if spec.path:
        write_parquet(out, spec.path, spec.mode, max_records=spec.max_records)
    if isinstance(spec.sink, str):
        SINKS[spec.sink](out, spec)
    elif spec.sink is not None:
        spec.sink.writer(out, spec.sink)
    return out
