"""The pattern runner and its outputs (CEP-01..19)."""

from __future__ import annotations

import functools
import itertools
import operator
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..model import ID, OP, TS
from ..operators.blocks import BLOCK, BLOCK_ROWS, OWN, Ranges, seconds_of, sequence_blocks
from ..operators.conditions import pattern_condition
from ..session import cut_lineage
from .nfa import Nfa
from .spec import PatternSpec, Stage

EVENTS, FIRST_LEN, SEQ = "_events", "_first_len", "_seq"


def match_pattern(df: DataFrame, spec: PatternSpec, order_by: Sequence[str] = (TS, ID),
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """CEP-01: matches of an ordered list of stages per key, in the spec's output form.

    ``order_by`` must order the events of a key totally and start with the event time.
    Patterns without an open quantifier run as window functions in the JVM; open
    quantifiers and the timeout output run :class:`Nfa` over Arrow batches.

    Events are cut into blocks of ``block_rows`` of one order over all keys, which run in
    parallel.  Only an open quantifier without a time bound reads a key in one
    task, in batches, holding open matches only.
    """
    if not spec.key_by:
        df = df.withColumn("_all", F.lit(0))
    keys = list(spec.key_by) or ["_all"]
    stages = _expand(spec.stages)
    if spec.output.kind == "timeout":
        matches = _nfa_matches(df, spec, keys, order_by, block_rows, timeouts=True)
    else:
        if any(s.quantifier for s in stages):
            matches = _nfa_matches(df, spec, keys, order_by, block_rows)
        else:
            matches = _window_matches(df, spec, stages, keys, order_by, block_rows)
        if spec.strategy != "no_skip":
            matches = _skip(matches, spec.strategy, keys, order_by, block_rows)
    out = write_matches(matches, df.schema, spec)
    return out if spec.key_by else out.drop("_all")


def _expand(stages: Sequence[Stage]) -> list[Stage]:
    """``times(n)`` is n single stages, the later ones reached by ``followedby``."""
    out: list[Stage] = []
    for s in stages:
        if s.quantifier == "times":
            out.append(Stage(s.kind, s.condition))
            out += [Stage("followedby", s.condition)] * (s.times - 1)
        else:
            out.append(s)
    return out


def _condition(stage: Stage, schema: T.StructType) -> Column:
    c = stage.condition
    if c is None:
        return F.lit(True)
    if isinstance(c, str):
        c = F.expr(c)
    elif not isinstance(c, Column):
        c = pattern_condition(c, schema)
    return F.coalesce(c, F.lit(False))


# -- window form ---------------------------------------------------------------------


def _window_matches(df: DataFrame, spec: PatternSpec, stages: Sequence[Stage],
                    keys: list[str], order_by: Sequence[str], block_rows: int) -> DataFrame:
    """Single-event stages: from the last stage back, each row looks up the first later
    row that can continue the match.  One exchange and one sort serve all stages."""
    if all(s.kind in ("begin", "next", "notnext") for s in stages):
        blocks = sequence_blocks(df, keys, order_by, after=len(stages), block_rows=block_rows)
        return _look_ahead(blocks.df, df, spec, stages, keys, order_by, _Ahead(blocks.by, order_by))
    # a match may span any number of blocks: each learns what the blocks behind it offer
    ranges = Ranges(df, keys, order_by, block_rows)
    frame = df.withColumns({BLOCK: ranges.block(), OWN: F.lit(True)})
    ahead = _AheadInBlocks(ranges) if ranges.cuts else _Ahead([*keys, BLOCK], order_by)
    return _look_ahead(frame, df, spec, stages, keys, order_by, ahead)


class _Ahead:
    """Looks up a value in the first later row of the same sequence that meets a condition."""

    def __init__(self, by: Sequence[str], order_by: Sequence[str]):
        self.by, self.order_by = list(by), list(order_by)

    def first(self, frame: DataFrame, name: str, cond: Column | None, value: Column) -> DataFrame:
        """``name``: the value there, null when no row qualifies."""
        # newest first, so that the first later row is the last one seen
        w = Window.partitionBy(*self.by).orderBy(*[F.col(c).desc() for c in self.order_by])
        if cond is None:
            return frame.withColumn(name, F.lag(value, 1).over(w))
        later = w.rowsBetween(Window.unboundedPreceding, -1)
        return frame.withColumn(name, F.last(F.when(cond, F.struct(value.alias("v"))),
                                             ignorenulls=True).over(later)["v"])


class _AheadInBlocks(_Ahead):
    """The same across the blocks of a key.

    A row first looks inside its block.  What a block offers to earlier ones is its first
    qualifying row of the key that runs on into it; one entry per block, read from the last
    block back, says what lies behind each.  Only the entries are written, never the events.
    """

    def __init__(self, ranges: Ranges):
        super().__init__([*ranges.keys, BLOCK], ranges.order_by)
        self.ranges = ranges
        run, self.runs = 0, []
        for number, cut in enumerate(ranges.cuts):
            run += number > 0 and ranges.key_of(cut) != ranges.key_of(ranges.cuts[number - 1])
            self.runs.append((number, run))

    def first(self, frame, name, cond, value):
        ranges, hit = self.ranges, F.lit(True) if cond is None else cond
        found = F.when(hit, F.struct(value.alias("v")))
        offered = frame.where(ranges.continues(F.col(BLOCK) - 1) & hit) \
            .groupBy((F.col(BLOCK) - 1).alias(BLOCK)).agg(F.min_by(found, ranges.place).alias("_offer"))
        behind = Window.partitionBy("_run").orderBy(F.col(BLOCK).desc()) \
            .rowsBetween(Window.unboundedPreceding, 0)
        carried = cut_lineage(
            ranges.spark.createDataFrame(self.runs, f"{BLOCK} int, _run int")
            .join(offered, BLOCK, "left")
            .select(BLOCK, F.last("_offer", ignorenulls=True).over(behind).alias("_carry")))
        w = Window.partitionBy(*self.by).orderBy(*[F.col(c).desc() for c in self.order_by]) \
            .rowsBetween(Window.unboundedPreceding, -1)
        # one entry per block
        return frame.withColumn("_local", F.last(found, ignorenulls=True).over(w)) \
            .join(F.broadcast(carried), BLOCK, "left") \
            .withColumn(name, F.coalesce("_local", F.when(
                ranges.continues(F.col(BLOCK)), F.col("_carry")))["v"]).drop("_local", "_carry")


def _look_ahead(frame: DataFrame, df: DataFrame, spec: PatternSpec, stages: Sequence[Stage],
                keys: list[str], order_by: Sequence[str], ahead: _Ahead) -> DataFrame:
    frame = frame.withColumns({f"_c{i}": _condition(s, df.schema) for i, s in enumerate(stages)})
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    position = F.struct(*order_by)
    rest: Column | None = None                  # what follows this row: events and end time
    guards: list[Column] = []                   # on the row that precedes the stage below
    begin_time = end_time = seconds_of(df, order_by[0])
    for i in range(len(stages) - 1, -1, -1):
        kind, holds = stages[i].kind, F.col(f"_c{i}")
        if kind == "notnext":
            # the next event is not of this kind (and there is one)
            frame = ahead.first(frame, f"_g{i}", None, ~holds)
            guards.append(F.coalesce(F.col(f"_g{i}"), F.lit(False)))
            if rest is None:
                frame = ahead.first(frame, "_end", None, end_time)
                end_time = F.col("_end")
            continue
        if kind == "notfollowedby":
            frame = ahead.first(frame, f"_g{i}", holds, position)
            # none of this kind up to the event that continues the match
            reached = F.struct(*[rest["e"][0][c].alias(c) for c in order_by])
            guards.append(F.col(f"_g{i}").isNull() | (F.col(f"_g{i}") > reached))
            continue
        usable = functools.reduce(operator.and_, guards, holds)
        if rest is None:
            found = F.struct(F.array(row).alias("e"), end_time.alias("t"))
        else:
            usable = usable & rest.isNotNull()
            found = F.struct(F.concat(F.array(row), rest["e"]).alias("e"), rest["t"].alias("t"))
        guards = []
        if kind == "begin":
            frame = frame.filter(F.col(OWN) & usable).withColumn("_found", found)
            break
        # followedby takes the first event that meets the stage's own condition, and
        # fails with it when the rest of the pattern does not continue from there
        frame = ahead.first(frame, f"_n{i}", None if kind == "next" else holds,
                            F.when(usable, found))
        rest = F.col(f"_n{i}")
    if spec.within_seconds > 0:
        frame = frame.filter(F.col("_found.t") - begin_time < spec.within_seconds)
    return frame.select(*keys, F.col("_found.e").alias(EVENTS),
                        F.lit(_begin_times(spec)).alias(FIRST_LEN), F.lit(0).cast("long").alias(SEQ))


def _begin_times(spec: PatternSpec) -> int:
    begin = spec.stages[0]
    return begin.times if begin.quantifier == "times" else 1


# -- stepwise form -------------------------------------------------------------------


def _nfa_matches(df: DataFrame, spec: PatternSpec, keys: list[str], order_by: Sequence[str],
                 block_rows: int, timeouts: bool = False) -> DataFrame:
    conds = [_condition(s, df.schema) for s in spec.stages]
    frame = df.withColumns({f"_c{i}": c for i, c in enumerate(conds)})
    if not any(s.kind in ("next", "notnext") for s in spec.stages):
        # without adjacency an event no stage asks for changes nothing
        frame = frame.filter(functools.reduce(operator.or_, [F.col(f"_c{i}")
                                                             for i in range(len(conds))]))
    if spec.within_seconds > 0:
        blocks = sequence_blocks(frame, keys, order_by, after_seconds=spec.within_seconds,
                                 block_rows=block_rows)
        frame, by = blocks.df, blocks.by
    else:
        frame, by = frame.withColumns({OWN: F.lit(True), BLOCK: F.lit(0).cast("long")}), \
            [*keys, BLOCK]
    # one sorted pass over each partition; the window marks where a key begins
    w = Window.partitionBy(*by).orderBy(*order_by)
    mask = functools.reduce(operator.add, [F.when(F.col(f"_c{i}"), F.lit(1 << i)).otherwise(0)
                                           for i in range(len(conds))])
    ordered = frame.select(
        (F.row_number().over(w) == 1).alias("_new"), OWN, seconds_of(df, order_by[0]).alias("_t"),
        mask.cast("long").alias("_mask"),
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    stages = tuple(Stage(s.kind, None, s.quantifier, s.times) for s in spec.stages)
    schema = T.StructType([T.StructField(EVENTS, T.ArrayType(df.schema)),
                           T.StructField(FIRST_LEN, T.IntegerType()),
                           T.StructField(SEQ, T.LongType())])
    run = _arrow_matcher(stages, spec.within_seconds, timeouts)
    return ordered.mapInArrow(run, schema) \
        .select(*[F.col(EVENTS)[0][k].alias(k) for k in keys], EVENTS, FIRST_LEN, SEQ)


def _arrow_matcher(stages: Sequence[Stage], within: float, timeouts: bool):
    """A ``mapInArrow`` function over ordered events.

    Python sees three numbers per event; the events themselves stay Arrow rows and are
    gathered by position.  From one batch to the next only events of open matches are
    kept.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nfa, partials, kept, seq = Nfa(stages, within), [], None, 0
        truth = {m: tuple(bool(m >> i & 1) for i in range(len(stages)))
                 for m in range(1 << len(stages))} if len(stages) < 12 else None
        pool = None
        for batch in batches:
            rows = batch.column("_row")
            base = 0 if kept is None else len(kept)
            pool = pa.concat_arrays([kept, rows]) if base else rows
            found: list = []
            for i, (new, own, ts, mask) in enumerate(zip(
                    *[batch.column(c).to_pylist() for c in ("_new", OWN, "_t", "_mask")])):
                if new:
                    if timeouts:
                        found += _distinct(partials)
                    partials = []
                conds = truth[mask] if truth else [mask >> c & 1 for c in range(len(stages))]
                partials, matches, late = nfa.feed(partials, conds, ts, base + i, own)
                found += _distinct(late) if timeouts else matches
            if found:
                yield gather(pool, found, seq)
                seq += len(found)
            used = sorted({e for p in partials for e in p.events})
            place = {e: n for n, e in enumerate(used)}
            partials = [p._replace(events=tuple(place[e] for e in p.events)) for p in partials]
            kept = pool.take(pa.array(used, pa.int64())) if used else None
        if timeouts and partials:
            yield gather(kept, _distinct(partials), seq)

    def gather(pool: pa.Array, found: list, seq: int) -> pa.RecordBatch:
        sizes = [len(f.events) for f in found]
        ends = pa.array([0, *itertools.accumulate(sizes)], pa.int32())
        events = pool.take(pa.array([e for f in found for e in f.events], pa.int64()))
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(ends, events),
             pa.array([f.first_len for f in found], pa.int32()),
             pa.array(range(seq, seq + len(found)), pa.int64())], names=[EVENTS, FIRST_LEN, SEQ])

    return run


def _distinct(partials: list) -> list:
    """Open matches over the same events count once."""
    return list({p.events: p for p in partials}.values())


# -- skip strategies -----------------------------------------------------------------


def _skip(matches: DataFrame, strategy: str, keys: list[str], order_by: Sequence[str],
          block_rows: int) -> DataFrame:
    """CEP-12: of a key's matches by first event and completion, those that do not start
    before the resume point of one kept before."""
    def at(index: Column) -> Column:
        return F.struct(*[F.element_at(EVENTS, index)[c].alias(f"o{j}")
                          for j, c in enumerate(order_by)])

    resume = {"skip_past_last_event": F.lit(-1), "skip_to_first": F.lit(1),
              "skip_to_last": F.greatest(F.col(FIRST_LEN), F.lit(1))}[strategy]
    strict = strategy == "skip_past_last_event"
    from .skip import keep_by_resume_point
    marked = matches.withColumns({"_s": at(F.lit(1)), "_r": at(resume)})
    return keep_by_resume_point(marked, keys, strict, block_rows).drop("_s", "_r")


# -- outputs -------------------------------------------------------------------------


def write_matches(matches: DataFrame, schema: T.StructType, spec: PatternSpec) -> DataFrame:
    """CEP-15..19: matches as one row, as their events, or as one chosen event."""
    events, fields = F.col(EVENTS), spec.output.fields
    names = schema.fieldNames()
    if spec.output.kind in ("detail", "timeout"):
        return matches.select(F.inline(events))
    if spec.output.kind == "filteredrow":
        f = fields[0]
        if f.function == "head":
            chosen = events[0]
        elif f.function == "last":
            chosen = F.element_at(events, -1)
        elif f.function in ("max", "min"):
            # the first event with the extreme value; ties keep the earlier one
            sign = operator.gt if f.function == "max" else operator.lt
            chosen = F.reduce(events, events[0], lambda best, e: F.when(
                best[f.field].isNull() | sign(e[f.field], best[f.field]), e).otherwise(best))
        else:
            raise ValueError(f"unknown output function {f.function!r}")
        return matches.select(chosen.alias("_row")).select(
            *[F.col(f"_row.`{n}`").alias(n) for n in names])
    columns = [F.array_max(_values(events, c)).alias(c) for c in (ID, TS, OP) if c in names]
    columns += [_aggregate(events, f.function, f.field, schema).alias(f.name) for f in fields]
    columns += [F.col(k) for k in (spec.key_by or ())]
    return matches.select(*columns)


def _values(events: Column, name: str) -> Column:
    return F.transform(events, lambda e: e[name])


def _aggregate(events: Column, function: str, name: str, schema: T.StructType) -> Column:
    """CEP-16: an aggregate over a match's events.

    Sums skip nulls; an average divides by the count of all events, by integer
    division for integer columns; a count counts events.
    """
    if function == "count":
        return F.size(events)
    values = _values(events, name)
    if function == "max":
        return F.array_max(values)
    if function == "min":
        return F.array_min(values)
    if function == "head":
        return values[0]
    if function == "last":
        return F.element_at(values, -1)
    dt = schema[name].dataType
    integral = isinstance(dt, T.IntegralType)
    wide = T.LongType() if integral else dt if isinstance(dt, T.DecimalType) else T.DoubleType()
    total = F.reduce(values, F.lit(0).cast(wide),
                     lambda acc, v: (acc + F.coalesce(v.cast(wide), F.lit(0).cast(wide))).cast(wide))
    if function == "sum":
        return total
    return (total / F.size(events)).cast(wide) if not integral else \
        F.call_function("div", total, F.size(events).cast("long"))
