"""Many flows on one stream, and the error policy (STM-15, STM-16)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame

from ..model import ID, FlowSpec
from ..operators.metrics import error_records
from ..plans.flow import decode, flow_rows, run_flow, sink_rows
from .hold import gated_writer, held_store

UNHANDLE, INTERRUPT, FEEDBACK = "unhandle", "interrupt", "feedback"


class FlowFailure(RuntimeError):
    """A flow failed and its policy is to stop."""


def flows_writer(flows: Sequence[FlowSpec], on_error: str = UNHANDLE,
                 feedback: Callable[[DataFrame, int], Any] | None = None,
                 failed: Callable[[str, int, Exception], Any] | None = None,
                 held: Mapping[str, str] | None = None,
                 alert: Callable[[DataFrame, int], Any] | None = None
                 ) -> Callable[[DataFrame, int], None]:
    """STM-15: a ``foreachBatch`` writer that gives one batch to every flow.

    The batch is cached, since each flow reads it.  A flow that fails does not stop
    the others.  STM-16 - ``unhandle``: ``failed`` is told and work goes on;
    ``interrupt``: the batch fails after every flow had its turn, so it is given
    again; ``feedback``: records of undecodable or failed rows go to ``feedback``.

    STM-11, STM-12: a flow with a validity gate keeps its held rows under the folder
    that ``held`` names for its label and sees them again in the next batch; ``alert``
    gets the rows that timed out.  Rows are merged by the sink's keys after the gate.
    A gate without such a folder is an error: its held rows would be lost.
    """
    if on_error not in (UNHANDLE, INTERRUPT, FEEDBACK):
        raise ValueError(f"unknown error policy {on_error!r}")
    for flow in flows:
        if flow.validity is not None and flow.label not in (held or {}):
            raise ValueError(f"flow {flow.label!r} has a validity gate; name a folder in held")

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        errors: list[tuple[str, Exception]] = []
        try:
            for flow in flows:
                try:
                    if on_error == INTERRUPT and flow.fields:
                        _refuse_bad_rows(batch, flow)
                    if on_error == FEEDBACK and feedback is not None and flow.fields:
                        feedback(bad_rows(batch, flow, batch_id), batch_id)
                    if flow.validity is not None:
                        _gated(flow, batch, batch_id, held[flow.label], alert)
                        continue
                    out = run_flow(flow, batch)
                    if flow.sink is not None:
                        flow.sink.writer(out, flow.sink, batch_id)
                except Exception as e:  # other flows must go on
                    errors.append((flow.label, e))
                    if failed is not None:
                        failed(flow.label, batch_id, e)
                    if on_error == FEEDBACK and feedback is not None:
                        feedback(error_records(batch, f"{type(e).__name__}: {e}",
                                               flow.source, flow.label, batch_id,
                                               batch.columns), batch_id)
        finally:
            batch.unpersist()
        if errors and on_error == INTERRUPT:
            raise FlowFailure("; ".join(f"{name}: {e}" for name, e in errors)) from errors[0][1]

    return run


def _gated(flow: FlowSpec, batch: DataFrame, batch_id: int, path: str,
           alert: Callable[[DataFrame, int], Any] | None) -> None:
    rows = decode(batch, flow) if flow.fields and ID not in batch.columns else batch

    def write(out: DataFrame, n: int) -> None:
        if flow.sink is not None:
            flow.sink.writer(sink_rows(flow, out), flow.sink, n)
    gated_writer(flow.validity, lambda df: flow_rows(flow, df), write, held_store(rows, path),
                 alert)(rows, batch_id)


def bad_rows(batch: DataFrame, flow: FlowSpec, batch_id: int | str) -> DataFrame:
    """Error records of the flow's rows whose cells do not convert, and of broken messages."""
    from ..sources.messages import classify_messages, malformed, match_namespace
    typed = decode(batch, flow, bad="only")
    cells = error_records(typed, "cell does not convert", flow.source, flow.label, batch_id,
                          ["tuple"])
    mine = classify_messages(batch).filter(match_namespace("namespace", flow.source))
    broken = error_records(malformed(mine), "message does not decode", flow.source, flow.label,
                           batch_id, ["key", "value"])
    return cells.unionByName(broken)


def _refuse_bad_rows(batch: DataFrame, flow: FlowSpec) -> None:
    first = bad_rows(batch, flow, "").limit(1).collect()
    if first:
        raise FlowFailure(f"{first[0]['reason']}: {first[0]['row']}")
