"""Rows kept between batches: validity gate and settling buffer (STM-11..13, SET-04)."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.casts import default_for
from ..model import TS, UID, Validity
from ..session import need_state_store, shared_dir
from .state import PART, _clean as clean, _numbers as numbers, dealt, move_timer

FATE = "_fate"
SEND, DROP, ALERT, HOLD = "send", "drop", "alert", "hold"


def is_valid(columns: Sequence[str], rule: str) -> Column:
    """``and``: every checked column is set and not empty; ``or``: at least one is."""
    checks = [F.coalesce(F.col(c).cast("string") != "", F.lit(False)) for c in columns]
    out = checks[0]
    for c in checks[1:]:
        out = out | c if rule == "or" else out & c
    return out


def validity(df: DataFrame, columns: Sequence[str], rule: str = "and", timeout_seconds: int = 0,
             action: str = DROP, ts_col: str = TS, min_ts: Column | None = None) -> DataFrame:
    """STM-11: add ``_fate`` - ``send``, ``hold``, or the action for timed-out rows.

    A valid row is sent.  An invalid one whose event time, in whole seconds, is at or
    before the batch's least event time minus the timeout gets the action (``drop``,
    ``alert`` or ``send``); others are held for the next batch.
    """
    if action not in (DROP, ALERT, SEND):
        raise ValueError(f"unknown action {action!r}")
    if min_ts is None:
        min_ts = df.agg(F.min(ts_col).alias("t")).scalar()
    limit = min_ts - F.expr(f"INTERVAL {int(timeout_seconds)} SECONDS")
    late = F.date_trunc("second", F.col(ts_col)) <= F.date_trunc("second", limit)
    return df.withColumn(FATE, F.when(is_valid(columns, rule), F.lit(SEND))
                         .when(late, F.lit(action)).otherwise(F.lit(HOLD)))


def settle(new: DataFrame, buffer: DataFrame | None, dedup_cols: Sequence[str],
           duration_seconds: int, ts_col: str = TS) -> DataFrame:
    """STM-13: buffered and new rows without duplicates, and ``_released`` for each.

    Released are rows at or before the greatest time minus the duration; with a
    duration of 0 or less, all.  Columns the buffer lacks are filled by type.
    """
    rows = new
    if buffer is not None:
        have = set(buffer.columns)
        rows = new.unionByName(buffer.select(*[
            F.col(f.name) if f.name in have else default_for(f.dataType).alias(f.name)
            for f in new.schema.fields]))
    # of equal rows the earliest stays, then the least in every column: no chance decides
    order = [F.col(c).asc_nulls_last() for c in (ts_col, *[
        f.name for f in rows.schema.fields if f.name != ts_col
        and not isinstance(f.dataType, (T.MapType, T.VariantType))])]
    first = F.row_number().over(Window.partitionBy(*dedup_cols).orderBy(*order))
    rows = rows.withColumn("_first", first).filter("_first = 1").drop("_first")
    if duration_seconds <= 0:
        return rows.withColumn("_released", F.lit(True))
    top = new.agg(F.max(ts_col).alias("t"))
    if buffer is not None:
        top = top.union(buffer.agg(F.max(ts_col).alias("t"))).agg(F.max("t").alias("t"))
    edge = top.scalar() - F.expr(f"INTERVAL {int(duration_seconds)} SECONDS")
    return rows.withColumn("_released", F.col(ts_col) <= edge)


class _Settling(StatefulProcessor):
    """Identities of a part: each one's earliest row, until the watermark has reached its time.

    After that a mark without the row stays for ``keep_ms`` of event time.
    """

    def __init__(self, ts_index, order, keep_ms, whole, names):
        self.ts_index, self.order, self.keep_ms = ts_index, order, keep_ms
        self.whole, self.names = whole, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "timer bigint, blob binary")

    def _load(self) -> tuple:
        """The part's timer, and by identity: milliseconds, row (null once it was released)."""
        stored = self.held.get()
        return (None, {}) if stored is None else (stored[0], pickle.loads(bytes(stored[1])))

    def _save(self, timer, held, fired=None) -> None:
        # a timer fires once the watermark is past it
        after = min((ms + self.keep_ms if row is None else ms - 1
                     for ms, row in held.values()), default=None)
        # the timer that fired is deleted behind this call
        after = after + 1 if after is not None and after == fired else after
        move_timer(self.handle, None if timer == fired else timer, after)
        if held:
            self.held.update((after, pickle.dumps(held)))
        else:
            self.held.clear()

    def _rank(self, row: tuple) -> tuple:
        return tuple((row[i] is None, 0 if row[i] is None else row[i]) for i in self.order)

    def handleInputRows(self, key, rows, timerValues):
        timer, held = self._load()
        for pdf in rows:
            for *row, identity, _ in pdf.itertuples(index=False, name=None):
                row = tuple(map(clean, numbers(row, self.whole)))
                before = held.get(identity)
                if before is None or before[1] is not None and \
                        self._rank(row) < self._rank(before[1]):
                    # whole milliseconds, up: a row is not released before its time
                    held[identity] = (-(-row[self.ts_index].value // 1_000_000), row)
        self._save(timer, held)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        timer, held = self._load()
        left, released = {}, []
        for identity, (ms, row) in held.items():
            if row is None:
                if ms + self.keep_ms >= passed:
                    left[identity] = (ms, None)
            elif ms > passed:
                left[identity] = (ms, row)
            else:
                released.append(row)
                if self.keep_ms:
                    left[identity] = (ms, None)
        self._save(timer, left, expiredTimerInfo.getExpiryTimeInMs())
        if released:
            yield pd.DataFrame(released, columns=self.names, dtype=object)
        else:
            yield from ()

    def close(self) -> None:
        pass


def settle_stream(df: DataFrame, dedup_cols: Sequence[str], duration_seconds: int,
                  ts_col: str = TS) -> DataFrame:
    """STM-13 on a stream: the released rows of :func:`settle`, state by parts of identities.

    The watermark is the greatest time minus the duration; an identity's earliest row (of
    equal times the least in every plain column) is released once the watermark
    reaches it.  For the duration after that, rows of the same identity are copies and
    dropped; later ones start anew, as they do in the batch form once a row has left its
    buffer.  Rows behind the watermark come too late and are dropped, as are rows without a
    time.  Times are compared in whole milliseconds, as watermarks are.
    """
    duration = max(0, int(duration_seconds))
    need_state_store(df.sparkSession)
    timed = df.filter(F.col(f"`{ts_col}`").isNotNull()).withWatermark(
        ts_col, f"{duration} seconds")
    frame, whole = dealt(timed, dedup_cols)
    nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    plain = [f.name for f in df.schema.fields
             if f.name != ts_col and not isinstance(f.dataType, nested)]
    order = [df.columns.index(c) for c in (ts_col, *plain)]
    processor = _Settling(order[0], order, duration * 1000, whole, df.columns)
    return frame.groupBy(PART).transformWithStateInPandas(
        processor, df.schema, "Append", "EventTime")


class Held:
    """Rows held from one micro-batch to the next, one folder per batch number.

    Batch ``n`` reads what ``n - 1`` left and replaces what ``n`` leaves, so a batch
    that is run again sees and writes the same rows.
    """

    def __init__(self, path: str, schema):
        self.path, self.schema = path, schema

    def before(self, spark, batch_id: int) -> DataFrame | None:
        from pyspark.errors import AnalysisException
        try:
            return spark.read.schema(self.schema).parquet(f"{self.path}/b={batch_id - 1}")
        except AnalysisException:
            return None

    def keep(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/b={batch_id}")


def gated_writer(gate: Validity, transform: Callable[[DataFrame], DataFrame],
                 write: Callable[[DataFrame, int], Any], held: Held,
                 alert: Callable[[DataFrame, int], Any] | None = None, ts_col: str = TS,
                 uid_col: str = UID) -> Callable[[DataFrame, int], None]:
    """STM-11, STM-12, SET-04: a ``foreachBatch`` writer with a validity gate.

    Held rows join the next batch before the transformation; source rows whose
    result is held are kept by their row identity, and the store is replaced.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = held.before(spark, batch_id)
        source = batch if earlier is None else batch.unionByName(earlier)
        source = source.persist()
        try:
            least = batch.agg(F.min(ts_col)).first()[0]
            fated = validity(transform(source), gate.columns, gate.rule, gate.timeout_seconds,
                             gate.action, ts_col, F.lit(least).cast("timestamp"))
            # decided once: the lookup behind it may change between reads
            path = f"{held.path}-fate/b={batch_id}"
            fated.write.mode("overwrite").parquet(path)
            fated = spark.read.parquet(path)
            write(fated.filter(F.col(FATE) == SEND).drop(FATE), batch_id)
            if alert is not None:
                alert(fated.filter(F.col(FATE) == ALERT).drop(FATE), batch_id)
            waiting = fated.filter(F.col(FATE) == HOLD).select(uid_col).distinct()
            held.keep(source.join(waiting, uid_col, "left_semi"), batch_id)
        finally:
            source.unpersist()

    return run


def settling_writer(dedup_cols: Sequence[str], duration_seconds: int,
                    write: Callable[[DataFrame, int], Any], held: Held, ts_col: str = TS
                    ) -> Callable[[DataFrame, int], None]:
    """STM-13: a ``foreachBatch`` writer that releases rows once they are old enough."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = settle(batch, held.before(spark, batch_id), dedup_cols, duration_seconds, ts_col)
        path = f"{held.path}-settled/b={batch_id}"
        rows.write.mode("overwrite").parquet(path)
        rows = spark.read.parquet(path)
        write(rows.filter("_released").drop("_released"), batch_id)
        held.keep(rows.filter("NOT _released").drop("_released"), batch_id)

    return run


def held_store(df: DataFrame, path: str | None = None) -> Held:
    return Held(path or shared_dir(df.sparkSession, "held"), df.schema)
