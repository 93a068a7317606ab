"""Ordered sequences, cut into blocks of one order over all keys.

Row-after-row operators (adjacent events, bounded frames, running totals, patterns) need a
key's rows in order.  A plain window sends all rows of a key to one task; when a key may hold
a third of the table, or when there is no key at all, that task is the job.  Here keys and
order columns together form one order over the whole frame, which is cut at sampled rows into
blocks of about ``block_rows`` rows (:class:`Ranges`).  Each row finds its block by a binary
search among the cuts, so splitting a key takes no join and no second shuffle, and every key,
long or short, goes the same way.

At most one key runs on from one block to the next.  What a block has to know about the rows
before or after it is therefore one entry per block: the place where the rows to repeat
begin, a running sum, a partial aggregate.  Such entries are computed by narrow aggregates
with a map-side step; there are as many as blocks, and they travel with the plan.  As the
driver holds them there, a frame is cut into ``MAX_BLOCKS`` at most: beyond ``MAX_BLOCKS *
block_rows`` rows it is the blocks that grow, not their number.
"""

from __future__ import annotations

import functools
import math
import operator
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

BLOCK, OWN = "_block", "_own"

#: rows that one block should hold
BLOCK_ROWS = 1_000_000
_EXACT = {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}

#: blocks that a frame is cut into at most, however small ``block_rows`` is
MAX_BLOCKS = 2048

#: sampled rows per block, among which the cuts are chosen
SAMPLES = 32


@dataclass(frozen=True)
class Blocks:
    """A frame split into blocks, and the columns that partition it."""

    df: DataFrame
    by: list[str]


def _equal(a, b) -> bool:
    return all(x == y or (x != x and y != y) for x, y in zip(a, b))


class Ranges:
    """Cuts of the order (``keys``, ``order_by``) into blocks, nulls first."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order_by: Sequence[str],
                 block_rows: int = BLOCK_ROWS):
        self.spark, self.keys, self.order_by = df.sparkSession, list(keys), list(order_by)
        rows = df.count()
        blocks = min(max(1, math.ceil(rows / block_rows)), MAX_BLOCKS)
        # times as whole numbers, which pass through the driver unchanged
        self.times = [isinstance(df.schema[c].dataType, T.TimestampType)
                      for c in (*self.keys, *self.order_by)]
        self.place = self.place_of(*[F.col(f"`{c}`") for c in self.order_by])
        self.type = df.select(self.place.alias("at")).schema["at"].dataType
        self.cuts: list = []
        if blocks > 1:
            sampled = df.select(self.place.alias("at"))
            if rows > SAMPLES * blocks:
                sampled = sampled.sample(SAMPLES * blocks / rows, seed=1)
            tiles = sampled.select("at", F.ntile(blocks).over(Window.orderBy("at")).alias("tile"))
            first = tiles.groupBy("tile").agg(F.min("at").alias("at")).where("tile > 1")
            self.cuts = [r["at"] for r in first.orderBy("tile").collect()]

    def place_of(self, *order: Column) -> Column:
        """A row's place in the order; places compare like rows."""
        fields = [F.unix_micros(c) if time else c for c, time in zip(
            (*[F.col(f"`{k}`") for k in self.keys], *order), self.times)]
        names = [*[f"k{i}" for i in range(len(self.keys))], *[f"o{i}" for i in range(len(order))]]
        return F.struct(*[c.alias(n) for c, n in zip(fields, names)])

    def entries(self, values: Sequence, dtype: T.DataType) -> Column:
        """One value per block, as a constant array of the plan."""
        schema = T.StructType([T.StructField("e", T.ArrayType(dtype))])
        text = self.spark.createDataFrame([(list(values),)], schema) \
            .select(F.to_json("e", _EXACT)).first()[0]
        return F.from_json(F.lit(text), schema["e"].dataType, _EXACT)

    def block(self, place: Column | None = None) -> Column:
        """The number of cuts up to a place, by binary search."""
        if not self.cuts:
            return F.lit(0)
        cuts, n = self.entries(self.cuts, self.type), len(self.cuts)
        steps = F.array(*[F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)])
        at = self.place if place is None else place
        # the place is made once per row, not once per step
        return F.transform(F.array(at), lambda at: F.reduce(steps, F.lit(0), lambda low, step: F.when(
            (low + step <= n) & (F.get(cuts, low + step - 1) <= at), low + step).otherwise(low)))[0]

    def key_of(self, cut) -> tuple:
        return tuple(cut)[:len(self.keys)]

    def continues(self, number: Column) -> Column:
        """Whether the row's key is that of the row at which cut ``number`` was made."""
        if not self.cuts:
            return F.lit(False)
        cut = F.get(self.entries(self.cuts, self.type), number)
        return functools.reduce(operator.and_, [
            self.place[f"k{i}"].eqNullSafe(cut[f"k{i}"]) for i in range(len(self.keys))],
            cut.isNotNull())

    def at_least(self, df: DataFrame, rows: int) -> None:
        """Drop cuts until every block but the last has ``rows`` rows."""
        if not self.cuts or rows < 1:
            return
        sizes = {r["b"]: r["n"] for r in df.groupBy(self.block().alias("b")).agg(
            F.count("*").alias("n")).collect()}
        kept, held = [], 0
        for number, cut in enumerate(self.cuts):
            held += sizes.get(number, 0)
            if held >= rows and sizes.get(number, 0) >= rows:
                kept.append(cut)
                held = 0
        self.cuts = kept

    def edges(self, df: DataFrame, rows: int, last: bool) -> Column:
        """Per block the place of its ``rows``-th row of the key that runs on, from its end or
        from its beginning (null: none, or no key runs on)."""
        number = F.col("b") if last else F.col("b") - 1
        order = F.col("at").desc() if last else F.col("at")
        some = df.withColumn("b", self.block()).where(self.continues(number)).select(
            "b", self.place.alias("at"))
        rank = F.row_number().over(Window.partitionBy("b").orderBy(order))
        found = {r["b"]: r["at"] for r in some.withColumn("n", rank)
                 .where(F.col("n") <= rows).groupBy("b")
                 .agg((F.min if last else F.max)("at").alias("at")).collect()}
        return self.entries([found.get(b) for b in range(len(self.cuts) + 1)], self.type)


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(keys)) if keys else (df.withColumn("_all", F.lit(0)), ["_all"])


def sequence_blocks(df: DataFrame, keys: Sequence[str], order_by: Sequence[str],
                    before: int = 0, after: int = 0, after_seconds: float | None = None,
                    block_rows: int = BLOCK_ROWS) -> Blocks:
    """Split each key's ordered rows into blocks.

    Adds ``_block`` and ``_own``.  A block's own rows have ``_own`` true; rows
    repeated from neighbours - ``before`` rows ahead of it, ``after`` rows behind it,
    and with ``after_seconds`` all rows within that time after its last own row -
    have it false.  ``order_by`` must order a key's rows totally and, for a reach in time,
    start with a timestamp or a number of seconds; rows without a time are in nobody's reach.
    Without keys the whole frame is one sequence.
    """
    if block_rows <= max(before, after):
        raise ValueError("block_rows must exceed the repeated rows")
    columns = df.columns
    df, keys = _keyed(df, keys)
    ranges = Ranges(df, keys, order_by, block_rows)
    ranges.at_least(df, max(before, after))
    placed = df.withColumn(BLOCK, ranges.block())
    home = F.col(BLOCK)
    copies = [F.struct(home.alias("b"), F.lit(True).alias("own"))]

    def copy(when: Column, to: Column) -> Column:
        return F.when(when, F.struct(to.alias("b"), F.lit(False).alias("own")))
    if ranges.cuts and before:
        edge = F.get(ranges.edges(df, before, last=True), home)
        copies.append(copy(ranges.continues(home) & (ranges.place >= edge), home + 1))
    if ranges.cuts and after:
        edge = F.get(ranges.edges(df, after, last=False), home)
        copies.append(copy(ranges.continues(home - 1) & (ranges.place <= edge), home - 1))
    split = F.array_compact(F.array(*copies))
    if ranges.cuts and after_seconds is not None:
        # earlier blocks that still have rows of this key up to so long before this row
        since = time_before(df, order_by[0], after_seconds)
        nothing = [F.lit(None).cast(df.schema[c].dataType) for c in order_by[1:]]
        first = F.when(F.col(f"`{order_by[0]}`").isNotNull(),
                       ranges.block(ranges.place_of(since, *nothing)))
        split = F.concat(split, F.when(first < home, F.transform(
            F.sequence(first, home - 1), lambda b: F.struct(b.alias("b"), F.lit(False).alias("own"))))
            .otherwise(F.array().cast("array<struct<b:int,own:boolean>>")))
    rows = placed.select("*", F.explode(split).alias("_c")) \
        .withColumns({BLOCK: F.col("_c.b"), OWN: F.col("_c.own")})
    return Blocks(rows.select(*[F.col(f"`{c}`") for c in columns],
                              *[k for k in keys if k not in columns], BLOCK, OWN), [*keys, BLOCK])


def seconds_of(df: DataFrame, col: str) -> Column:
    """Epoch seconds of a time column; a numeric column as it is."""
    c = F.col(col)
    if isinstance(df.schema[col].dataType, (T.TimestampNTZType, T.DateType)):
        c = c.cast("timestamp")
    return c.cast("double")


def time_before(df: DataFrame, col: str, seconds: float) -> Column:
    """A time column, or a numeric one, some seconds back, in its own type."""
    dt, c = df.schema[col].dataType, F.col(f"`{col}`")
    if isinstance(dt, T.NumericType):
        back = c.cast("double") - seconds
        return (F.floor(back) if isinstance(dt, T.IntegralType) else back).cast(dt)
    micros = F.unix_micros(c.cast("timestamp")) - math.ceil(seconds * 1_000_000)
    return F.timestamp_micros(micros).cast(dt)


def over_rows(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], preceding: int,
              aggs: dict[str, Column], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """WIN-02: aggregates over the ``preceding`` rows before each row and the row itself.

    ``aggs`` are aggregate Columns; they see the frame in order, so ``F.first`` and
    ``F.last`` are the frame forms of AGG-05 and AGG-06.
    """
    blocks = sequence_blocks(df, keys, order_by, before=preceding, block_rows=block_rows)
    w = Window.partitionBy(*blocks.by).orderBy(*order_by).rowsBetween(-preceding, 0)
    return blocks.df.withColumns({n: c.over(w) for n, c in aggs.items()}) \
        .filter(OWN).select(*df.columns, *aggs)


def running_sums(df: DataFrame, keys: Sequence[str], order_by: Sequence[str],
                 sums: dict[str, str], block_rows: int = BLOCK_ROWS,
                 totals: dict[str, str] | None = None) -> DataFrame:
    """WIN-02: per alias the sum of a column from a key's first row to the current one, and
    per alias of ``totals`` the sum over all rows of the key.

    Each block sums its own rows and adds what its first key has in the blocks before it (for
    totals also what its last key has in those behind it).  A sum is null until a value came.
    Whole numbers are summed as long, so a sum of ones is a row's number in its key.
    """
    columns, totals = df.columns, totals or {}
    df, keys = _keyed(df, keys)
    ranges = Ranges(df, keys, order_by, block_rows)
    wide = {a: _wide(df.schema[c].dataType) for a, c in (sums | totals).items()}
    values = {a: F.col(f"`{c}`").cast(wide[a]) for a, c in (sums | totals).items()}
    placed, home = df.withColumn(BLOCK, ranges.block()), F.col(BLOCK)
    w = Window.partitionBy(*keys, BLOCK)
    up_to = w.orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    out = {a: F.sum(v).over(up_to if a in sums else w) for a, v in values.items()}

    def add(names: Sequence[str], step: int) -> None:
        """Carry sums of the rows whose key runs on, block by block up (1) or down (-1)."""
        blocks = len(ranges.cuts) + 1
        carried_to = range(1, blocks) if step > 0 else range(blocks - 2, -1, -1)
        here = {r[BLOCK]: r for r in placed.where(
            ranges.continues(F.greatest(home, home + step) - 1)).groupBy(BLOCK)
                .agg(*[F.sum(values[a]).alias(a) for a in names]).collect()}
        carried, now, last = [None] * blocks, dict.fromkeys(names), None
        for to in carried_to:
            cut = ranges.key_of(ranges.cuts[min(to, to - step)])
            if last is None or not _equal(cut, last):
                now = dict.fromkeys(names)
            last = cut
            for a in names if to - step in here else ():
                more = here[to - step][a]
                now[a] = now[a] if more is None else more if now[a] is None else now[a] + more
            carried[to] = tuple(now.values())
        entry = F.get(ranges.entries(carried, T.StructType(
            [T.StructField(a, wide[a]) for a in names])), home)
        mine = ranges.continues(F.least(home, home - step))
        for a in names:
            base = F.when(mine, entry[a])
            out[a] = F.coalesce((base + out[a]).cast(wide[a]), out[a], base)
    if ranges.cuts:
        add(list(wide), 1)
        if totals:
            add(list(totals), -1)
    return placed.select(*[F.col(f"`{c}`") for c in columns], *[c.alias(a) for a, c in out.items()])


def _wide(dt: T.DataType) -> T.DataType:
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return T.DoubleType()
    return T.DecimalType(38, dt.scale) if isinstance(dt, T.DecimalType) else T.LongType()


def running_total(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], col: str,
                  alias: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """WIN-02: sum of a column from a key's first row to the current one."""
    return running_sums(df, keys, order_by, {alias: col}, block_rows)


#: partial aggregates: over a window, over a group of rows with a place, and of two runs of
#: rows, the earlier one first, as Columns and as values; nulls do not count
_PARTS = {
    "sum": (F.sum, lambda v, at: F.sum(v), lambda a, b: F.coalesce(a + b, a, b), operator.add),
    "min": (F.min, lambda v, at: F.min(v), F.least, min),
    "max": (F.max, lambda v, at: F.max(v), F.greatest, max),
    "first": (lambda v: F.first(v, ignorenulls=True),
              lambda v, at: F.min_by(v, F.when(v.isNotNull(), at)), F.coalesce, lambda a, b: a),
    "last": (lambda v: F.last(v, ignorenulls=True),
             lambda v, at: F.max_by(v, F.when(v.isNotNull(), at)),
             lambda a, b: F.coalesce(b, a), lambda a, b: b),
}


def merged_parts(parts: dict[str, str], at: Column) -> list[Column]:
    """Aggregates that merge partial aggregates (name to kind), for ``groupBy(...).agg``."""
    return [_PARTS[kind][1](F.col(n), at).alias(n) for n, kind in parts.items()]


def running_parts(df: DataFrame, keys: Sequence[str], order_by: Sequence[str],
                  parts: dict[str, str], now: str, before: str | None = None,
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """WIN-02: partial aggregates from a key's first row to the current one.

    ``parts`` names columns and how they merge: ``sum``, ``min``, ``max``, ``first`` or ``last``;
    nulls do not count.  Adds a struct ``now`` with a field per part and, when named, a struct
    ``before`` of the rows ahead of the current one.  As in :func:`running_sums` each block
    learns of the blocks before it by one entry.
    """
    columns = df.columns
    df, keys = _keyed(df, keys)
    df = df.withColumns({n: F.col(n).cast(_wide(df.schema[n].dataType))
                         for n, kind in parts.items() if kind == "sum"})
    ranges = Ranges(df, keys, order_by, block_rows)
    placed, home = df.withColumn(BLOCK, ranges.block()), F.col(BLOCK)
    up_to = Window.partitionBy(*keys, BLOCK).orderBy(*order_by)
    ends = {now: 0} if before is None else {now: 0, before: -1}
    base = None
    if ranges.cuts:
        here = {r[BLOCK]: r for r in placed.where(ranges.continues(home)).groupBy(BLOCK)
                .agg(*merged_parts(parts, ranges.place)).collect()}
        carried: list = [None]
        held = dict.fromkeys(parts)
        for to, cut in enumerate(ranges.cuts, 1):
            if to > 1 and not _equal(ranges.key_of(cut), ranges.key_of(ranges.cuts[to - 2])):
                held = dict.fromkeys(parts)
            for n, kind in parts.items() if to - 1 in here else ():
                more = here[to - 1][n]
                held[n] = held[n] if more is None else more if held[n] is None else \
                    _PARTS[kind][3](held[n], more)
            carried.append(tuple(held.values()))
        entry = F.get(ranges.entries(carried, T.StructType([df.schema[n] for n in parts])), home)
        base = F.when(ranges.continues(home - 1), entry)

    def frame(end: int) -> Column:
        w = up_to.rowsBetween(Window.unboundedPreceding, end)
        own = {n: _PARTS[kind][0](F.col(n)).over(w) for n, kind in parts.items()}
        return F.struct(*[(own[n] if base is None else _PARTS[kind][2](base[n], own[n])
                           .cast(df.schema[n].dataType)).alias(n) for n, kind in parts.items()])
    return placed.select(*[F.col(f"`{c}`") for c in columns],
                         *[frame(end).alias(name) for name, end in ends.items()])


_MERGE = {
    "count": lambda a, b: a + b,
    "sum": lambda a, b: F.coalesce((a + b), a, b),
    "min": F.least,
    "max": F.greatest,
}


def over_range(df: DataFrame, keys: Sequence[str], order_by: str, seconds: int,
               aggs: dict[str, Column], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """WIN-02: aggregates over the ``seconds`` up to each row's time, peers included.

    ``aggs`` are counts, sums, least or greatest values.  A frame is the end of the block in
    which it begins, whole blocks, and the beginning of the row's own block.  The first part is
    asked for by one narrow row, the second read from a table of partial aggregates over runs
    of 1, 2, 4, ... blocks; no row is repeated however long the frame is.
    """
    kinds = {}
    for name, c in aggs.items():
        kinds[name] = re.match(r"Column<'(\w*)", str(c))[1].lower()
        if kinds[name] not in _MERGE:
            raise ValueError(f"{name}: over_range takes {', '.join(_MERGE)}")
    columns, width = df.columns, seconds * 1_000_000
    df, keys = _keyed(df, keys)
    # ties in time stay in one block, so peers are together
    ranges = Ranges(df, keys, [order_by], block_rows)
    micros = F.unix_micros(F.col(f"`{order_by}`").cast("timestamp"))
    placed = df.withColumns({BLOCK: ranges.block(), "_t": micros})
    if not ranges.cuts:
        w = Window.partitionBy(*keys, BLOCK).orderBy("_t").rangeBetween(-width, 0)
        return placed.select(*columns, *[c.over(w).alias(n) for n, c in aggs.items()])

    since = ranges.place_of(time_before(df, order_by, seconds))
    placed = placed.withColumn("_from", F.when(F.col("_t").isNull(), F.col(BLOCK)).otherwise(
        ranges.block(since)))
    # ends of earlier blocks: rows, and the questions of later rows, dealt by key and block
    asked = F.when(F.col("_from") < F.col(BLOCK), F.struct(
        F.col("_from").alias("b"), (F.col("_t") - width).alias("t"), F.lit(True).alias("asks")))
    own = F.struct(F.col(BLOCK).alias("b"), F.col("_t").alias("t"), F.lit(False).alias("asks"))
    dealt = placed.select("*", F.explode(F.array_compact(F.array(own, asked))).alias("_c")) \
        .withColumns({"_home": F.col(BLOCK), "_at": F.col("_t"), BLOCK: F.col("_c.b"),
                      "_t": F.col("_c.t"), "_asks": F.col("_c.asks")}) \
        .repartition(*keys, BLOCK)
    # from the latest row back, so that both frames grow by one row at a time
    back = Window.orderBy(F.col("_t").desc()).rangeBetween(Window.unboundedPreceding, 0)
    later, next_ = back.partitionBy(*keys, BLOCK, "_asks"), back.partitionBy(*keys, BLOCK)
    ends = F.struct(*[c.over(later).alias(n) for n, c in aggs.items()])
    answers = dealt.withColumn("_end", F.when(~F.col("_asks") & F.col("_t").isNotNull(), ends)) \
        .withColumn("_end", F.last("_end", ignorenulls=True).over(next_)) \
        .where("_asks").select(*keys, F.col("_home").alias(BLOCK), F.col("_at").alias("_t"), "_end")

    home = placed.withColumn("_row", F.lit(True)).unionByName(
        answers, allowMissingColumns=True).repartition(*keys, BLOCK)
    peers = Window.partitionBy(*keys, BLOCK).orderBy("_t").rangeBetween(0, 0)
    begin = Window.partitionBy(*keys, BLOCK, "_row").orderBy("_t").rangeBetween(-width, 0)
    table = _runs_of_blocks(placed, ranges, aggs, kinds)
    found = home.withColumn("_end", F.first("_end", ignorenulls=True).over(peers)) \
        .withColumns({f"_b_{n}": c.over(begin) for n, c in aggs.items()}).where("_row") \
        .withColumn("_mid", _read_runs(table, F.col("_from") + 1, F.col(BLOCK), kinds,
                                       len(ranges.cuts) + 1))

    def whole(n: str) -> Column:
        parts = [F.col("_end")[n], F.col("_mid")[n], F.col(f"_b_{n}")]
        if kinds[n] == "count":
            parts = [F.coalesce(p, F.lit(0)) for p in parts]
        return functools.reduce(_MERGE[kinds[n]], parts)
    return found.select(*[F.col(f"`{c}`") for c in columns], *[whole(n).alias(n) for n in aggs])


def _runs_of_blocks(placed: DataFrame, ranges: Ranges, aggs: dict[str, Column],
                    kinds: dict[str, str]) -> Column:
    """``table[k][b]``: aggregates over the blocks b to b + 2^k - 1, as one constant."""
    per_block = placed.groupBy(BLOCK).agg(*[c.alias(n) for n, c in aggs.items()])
    dtype = T.StructType([T.StructField(n, per_block.schema[n].dataType) for n in aggs])
    none = tuple(0 if kinds[n] == "count" else None for n in aggs)
    rows = {r[BLOCK]: tuple(r[n] for n in aggs) for r in per_block.collect()}
    merge = {"count": operator.add, "sum": operator.add, "min": min, "max": max}

    def both(a, b):
        return tuple(y if x is None else x if y is None else merge[kinds[n]](x, y)
                     for n, x, y in zip(aggs, a, b))
    blocks = len(ranges.cuts) + 1
    table, step = [[rows.get(b, none) for b in range(blocks)]], 1
    while 2 * step <= blocks:
        last = table[-1]
        table.append([both(last[b], last[b + step]) for b in range(blocks - 2 * step + 1)])
        step *= 2
    return ranges.entries(table, T.ArrayType(dtype))


def _read_runs(table: Column, first: Column, end: Column, kinds: dict[str, str],
               blocks: int) -> Column:
    """Aggregates over the blocks from ``first`` up to, without, ``end`` (null: no block)."""
    levels = F.array(*[F.lit(k) for k in range(blocks.bit_length() - 1, -1, -1)])

    def add(state: Column, k: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1), k)
        run = F.get(F.get(table, k), state["at"])
        old = state["all"]
        merged = F.when(old.isNull(), run).otherwise(F.struct(*[
            _MERGE[kind](old[n], run[n]).alias(n) for n, kind in kinds.items()]))
        return F.when(state["at"] + width <= end, F.struct(
            (state["at"] + width).alias("at"), merged.alias("all"))).otherwise(state)
    nothing = F.when(F.lit(False), F.get(F.get(table, F.lit(0)), F.lit(0)))
    return F.reduce(levels, F.struct(first.alias("at"), nothing.alias("all")), add,
                    lambda state: state["all"])
