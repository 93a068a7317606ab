"""Stateful operators: aggregates whose idle keys are forgotten by the clock, and pattern
matching on streams (STM-07, STM-09, CEP-01 on streams).

Both use ``transformWithStateInPandas`` on the RocksDB state store.  Aggregates keep an entry
per key; patterns (and :mod:`.hold`) deal the keys into ``PARTS`` parts by their hash and keep
an entry per part, so that calls to the store grow with parts and batches, not with keys.  A
key lies in one part: a stream's hottest key bounds its rate; choose keys accordingly.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..model import ID, TS
from ..patterns.match import EVENTS, FIRST_LEN, SEQ, _condition, write_matches
from ..patterns.nfa import Nfa, Partial
from ..patterns.spec import PatternSpec, Stage
from ..session import need_state_store

# Default idle-state retention.
MIN_IDLE_HOURS, MAX_IDLE_HOURS = 12, 24

#: parts of the keys that share an entry of the state store; fixed as long as a checkpoint lives
PARTS = 1024
PART, IDENTITY = "_part", "_identity"
_PLAIN = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS XXXXX",
          "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}

#: aggregate name -> (start value, step, result)
_FOLDS = {
    "count": (0, lambda a, v: a + 1, lambda a: a),
    "sum": (None, lambda a, v: a if v is None else v if a is None else a + v, lambda a: a),
    "min": (None, lambda a, v: a if v is None else v if a is None else min(a, v), lambda a: a),
    "max": (None, lambda a, v: a if v is None else v if a is None else max(a, v), lambda a: a),
    "avg": ((0, 0.0), lambda a, v: a if v is None else (a[0] + 1, a[1] + v),
            lambda a: a[1] / a[0] if a[0] else None),
    "first": ((), lambda a, v: a or (v,), lambda a: a[0] if a else None),
    "last": (None, lambda a, v: v, lambda a: a),
}


def _exact(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[int]]:
    """Whole numbers as text, and where they are: pandas would make doubles of them
    as soon as one null stands beside them."""
    whole = [i for i, f in enumerate(df.schema.fields)
             if isinstance(f.dataType, T.IntegralType) and f.name not in keys]
    names = {df.columns[i] for i in whole}
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) if c in names else F.col(f"`{c}`")
                       for c in df.columns]), whole


def _numbers(row: tuple, whole: Sequence[int]) -> tuple:
    """The row with its whole numbers back."""
    out = list(row)
    for i in whole:
        out[i] = None if _clean(out[i]) is None else int(out[i])
    return tuple(out)


def _clean(v: Any) -> Any:
    return None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v


def dealt(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[int]]:
    """The rows with whole numbers as text (and where they are), behind them two columns: the
    key as one text, and the part of the state it belongs to."""
    frame, whole = _exact(df, [])
    # adding 0 makes one zero of both
    parts = [F.col(f"`{k}`") + F.lit(0.0).cast(df.schema[k].dataType)
             if isinstance(df.schema[k].dataType, (T.FloatType, T.DoubleType)) else F.col(f"`{k}`")
             for k in keys]
    identity = F.to_json(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(parts)]), _PLAIN)
    frame = frame.withColumn(IDENTITY, identity)
    return frame.withColumn(PART, F.pmod(F.xxhash64(IDENTITY), F.lit(PARTS)).cast("int")), whole


def move_timer(handle: StatefulProcessorHandle, before: int | None, after: int | None) -> None:
    """One timer per part."""
    if before == after:
        return
    if before is not None:
        handle.deleteTimer(before)
    if after is not None:
        handle.registerTimer(after)


def agg_fields(df: DataFrame, aggs: Mapping[str, tuple[str, str]]) -> list[T.StructField]:
    out = []
    for alias, (function, column) in aggs.items():
        if function == "count":
            dt: T.DataType = T.LongType()
        elif function == "avg":
            dt = T.DoubleType()
        else:
            dt = df.schema[column].dataType
            if function == "sum" and isinstance(dt, T.IntegralType):
                dt = T.LongType()
        out.append(T.StructField(alias, dt))
    return out


class _RunningAgg(StatefulProcessor):
    def __init__(self, keys, aggs, idle_ms, whole):
        self.keys, self.aggs, self.idle_ms = keys, aggs, idle_ms
        self.whole = whole

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("acc", "blob binary", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues
                        ) -> Iterator[pd.DataFrame]:
        stored = self.state.get() if self.state.exists() else None
        acc = pickle.loads(stored[0]) if stored else None
        for pdf in rows:
            columns = [[None] * len(pdf) if f == "count" else
                       [None if _clean(v) is None else int(v) for v in pdf[c].tolist()]
                       if c in self.whole else pdf[c].tolist() for f, c in self.aggs]
            for values in zip(*columns):
                if acc is None:
                    acc = [_FOLDS[f][0] for f, _ in self.aggs]
                acc = [_FOLDS[f][1](a, _clean(v)) for (f, _), a, v in zip(self.aggs, acc, values)]
        self.state.update((pickle.dumps(acc),))
        yield pd.DataFrame([(*key, *self._result(acc))], columns=self.names, dtype=object)

    def _result(self, acc):
        return [_FOLDS[f][2](a) for (f, _), a in zip(self.aggs, acc)]

    def close(self) -> None:
        pass


def running_agg(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, tuple[str, str]],
                idle_hours: float | None = None) -> DataFrame:
    """STM-07, STM-09: unwindowed aggregate that emits its changes (output mode update).

    ``aggs`` maps names to (count/sum/min/max/avg, column).  Each batch gives one new row
    per changed key, by Spark's own aggregate in update mode unless idle keys are to be
    forgotten.  Old and new rows with a change flag: :class:`.totals.ChangingTotals`.

    With ``idle_hours`` (``MAX_IDLE_HOURS`` is the usual value) a key idle that long by
    the clock is forgotten.  Such a stream needs a processing-time trigger: clock
    timers keep an ``availableNow`` run from ending.
    """
    if idle_hours is None:
        return df.groupBy(*keys).agg(*[spark_agg(df, f, c).alias(a)
                                       for a, (f, c) in aggs.items()])
    frame, whole = _exact(df, keys)
    processor = _RunningAgg(list(keys), list(aggs.values()), int(idle_hours * 3_600_000),
                            {df.columns[i] for i in whole})
    schema = T.StructType([df.schema[k] for k in keys] + agg_fields(df, aggs))
    processor.names = schema.names
    need_state_store(df.sparkSession)
    return frame.groupBy(*keys).transformWithStateInPandas(
        processor, schema, "Update", "ProcessingTime")


def spark_agg(df: DataFrame, function: str, column: str):
    if function == "count":
        return F.count(F.lit(1))
    whole = function == "sum" and isinstance(df.schema[column].dataType, T.IntegralType)
    value = F.col(column).cast("long") if whole else F.col(column)
    return {"sum": F.sum, "min": F.min, "max": F.max, "first": F.first, "last": F.last,
            "avg": lambda c: F.avg(c.cast("double"))}[function](value)


class _InOrder(StatefulProcessor):
    """Feeds each key's rows to ``fold`` in event order once the watermark has passed them.

    The rows of a part's keys wait in a list state.  Each key is looked at when one of its
    alarms has passed: that of the earliest waiting row, or the time the fold asks to be woken.
    The folded state is dropped once the key was idle for ``idle_ms`` of event time.
    """

    def __init__(self, fold, names, ts_index, order_index, key_index, idle_ms, whole):
        self.fold, self.names, self.ts_index, self.whole = fold, names, ts_index, whole
        self.order_index, self.key_index, self.idle_ms = order_index, key_index, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.keys = handle.getValueState("keys", "timer bigint, blob binary")

    def _load(self) -> tuple:
        """The part's timer, and by key: alarms, key, folded state, latest time."""
        stored = self.keys.get()
        return (None, {}) if stored is None else (stored[0], pickle.loads(bytes(stored[1])))

    def _save(self, timer, keys) -> None:
        after = min((min(k[0]) for k in keys.values() if k[0]), default=None)
        move_timer(self.handle, timer, after)
        if keys:
            self.keys.update((after, pickle.dumps(keys)))
        else:
            self.keys.clear()

    def handleInputRows(self, key, rows, timerValues):
        timer, keys = self._load()
        for pdf in rows:
            new, first = [], {}
            # by position: names that start with an underscore do not survive the transfer
            for *row, identity, _ in pdf.itertuples(index=False, name=None):
                # released only after the whole millisecond is behind the watermark
                ms = int(row[self.ts_index].value // 1_000_000) + 1
                row = _numbers(row, self.whole)
                new.append((identity, ms, row))
                first[identity] = min(ms, first.get(identity, ms))
                if identity not in keys:
                    keys[identity] = (set(), tuple(_clean(row[i]) for i in self.key_index), None, None)
            for identity, ms in first.items():
                keys[identity][0].add(ms)
            if new:
                self.waiting.appendValue((pickle.dumps(new),))
        self._save(timer, keys)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        timer, keys = self._load()
        due = {i: ([], []) for i, k in keys.items() if k[0] and min(k[0]) < passed}
        rest = []
        for blob, in self.waiting.get():
            for entry in pickle.loads(bytes(blob)):
                mine = due.get(entry[0])
                if mine is not None and entry[1] <= passed:
                    mine[0].append(entry)
                else:
                    rest.append(entry)
                    if mine is not None:
                        mine[1].append(entry[1])
        if rest:
            self.waiting.put([(pickle.dumps(rest),)])
        else:
            self.waiting.clear()
        found: list = []
        for identity, (passing, later) in due.items():
            alarms, values, state, last_ms = keys.pop(identity)
            alarms_due = sum(a < passed for a in alarms)
            alarms = {a for a in alarms if a >= passed}
            for _ in range(alarms_due):
                if later:
                    alarms.add(min(later))
                if not passing and last_ms is None:
                    continue
                rows = sorted((row for _, _, row in passing),
                              key=lambda r: tuple(r[i] for i in self.order_index))
                last_ms = max([*[ms for _, ms, _ in passing], *([] if last_ms is None else [last_ms])])
                state, out, wake = self.fold(values, state, rows, passed)
                found += out
                if not rows and not later and last_ms + self.idle_ms <= passed:
                    state = last_ms = None
                else:
                    idle = last_ms + self.idle_ms
                    alarms.add(idle if wake is None else min(wake, idle))
                passing = []
            if alarms or last_ms is not None:
                keys[identity] = (alarms, values, state, last_ms)
        fired = expiredTimerInfo.getExpiryTimeInMs()
        for alarms, *_ in keys.values():
            # the timer that fired is deleted behind this call
            if fired in alarms:
                alarms.remove(fired)
                alarms.add(fired + 1)
        self._save(None if timer == fired else timer, keys)
        if found:
            yield pd.DataFrame(found, columns=self.names, dtype=object)
        else:
            yield from ()

    def close(self) -> None:
        pass


def _in_order(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], fold, schema,
              idle_hours: float) -> DataFrame:
    columns = df.columns
    need_state_store(df.sparkSession)
    frame, whole = dealt(df, keys)
    processor = _InOrder(fold, schema.names, columns.index(order_by[0]),
                         [columns.index(c) for c in order_by], [columns.index(k) for k in keys],
                         int(idle_hours * 3_600_000), whole)
    return frame.groupBy(PART).transformWithStateInPandas(
        processor, schema, "Append", "EventTime")


class _PatternFold:
    def __init__(self, stages, within, columns, n_conds, ts_index, timeouts):
        self.stages, self.within, self.columns = stages, within, columns
        self.n_conds, self.ts_index, self.timeouts = n_conds, ts_index, timeouts

    def __call__(self, key, state, rows, passed):
        nfa = Nfa(self.stages, self.within)
        open_matches, seq = state or ([], 0)
        partials = [Partial(*p) for p in open_matches]
        found = []
        n = len(self.columns) - self.n_conds
        for row in rows:
            event = dict(zip(self.columns[:n], row[:n]))
            partials, matches, late = nfa.feed(
                partials, row[n:], row[self.ts_index].value / 1e9, event)
            for m in self._once(late) if self.timeouts else matches:
                found.append((*key, list(m.events), m.first_len, seq))
                seq += 1
        wake = None
        if self.within > 0:
            # no event before the watermark can still come, so these matches are too late
            late = [p for p in partials if (p.start + self.within) * 1000 <= passed]
            partials = [p for p in partials if (p.start + self.within) * 1000 > passed]
            for p in self._once(late) if self.timeouts else []:
                found.append((*key, list(p.events), p.first_len, seq))
                seq += 1
            if partials:
                wake = int((min(p.start for p in partials) + self.within) * 1000) + 1
        # plain tuples: the state must load without this package
        return ([tuple(p) for p in partials], seq), found, wake

    @staticmethod
    def _once(partials: list) -> list:
        """Open matches over the same events count once."""
        return list({tuple(id(e) for e in p.events): p for p in partials}.values())


def match_pattern_stream(df: DataFrame, spec: PatternSpec, order_by: Sequence[str] = (TS, ID),
                         idle_hours: float = MAX_IDLE_HOURS) -> DataFrame:
    """CEP on a stream: events in order behind the watermark, open matches as state.

    Needs a watermark and ``key_by``.  The timeout output gives an open match once the
    watermark is ``within_seconds`` past its first event.  Skip strategies need all matches of a key and
    run on the stored output (:func:`changeloom.patterns.match_pattern`).
    """
    if not spec.key_by:
        raise ValueError("a streaming pattern needs key_by")
    if spec.strategy != "no_skip":
        raise ValueError("a streaming pattern runs without skipping")
    keys = list(spec.key_by)
    conds = [_condition(s, df.schema) for s in spec.stages]
    frame = df.withColumns({f"_c{i}": c for i, c in enumerate(conds)})
    schema = T.StructType([df.schema[k] for k in keys]
                          + [T.StructField(EVENTS, T.ArrayType(df.schema)),
                             T.StructField(FIRST_LEN, T.IntegerType()),
                             T.StructField(SEQ, T.IntegerType())])
    fold = _PatternFold([Stage(s.kind, None, s.quantifier, s.times) for s in spec.stages],
                        spec.within_seconds, frame.columns, len(conds),
                        frame.columns.index(order_by[0]), spec.output.kind == "timeout")
    matches = _in_order(frame, keys, order_by, fold, schema, idle_hours)
    return write_matches(matches, df.schema, spec)
