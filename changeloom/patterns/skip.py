"""Skip strategies over all matches at once (CEP-12).

A kept match names the next one: the first that does not start before its resume point.  So
the matches of a key are a linked list with dead ends, and what is kept is what can be reached
from the key's first match.  Matches are numbered in one order; runs of numbers are blocks.
Inside a block pointers are doubled column-wise, which gives for every match the first one
behind the block that it leads to: the block as a function from entry to exit.  Functions of
following blocks are composed by doubling too, on the few matches at which a block can be
entered at all, so a key with any number of matches is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.blocks import BLOCK_ROWS, running_sums
from ..session import cut_lineage


def keep_by_resume_point(matches: DataFrame, keys: Sequence[str], strict: bool,
                         block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Keep a match unless it starts before the resume point of an earlier kept one.

    ``_s`` is a match's first event and ``_r`` its resume point, both as structs that
    compare in event order; with ``strict`` a start at the resume point is dropped
    too.  ``_seq`` orders matches of one start.
    """
    matches = cut_lineage(matches)
    fields = matches.schema["_s"].dataType.fieldNames()
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    key, start = list(names.values()), [f"_s{i}" for i in range(len(fields))]
    at = [f"_at{i}" for i in range(len(fields))]
    narrow = matches.select(*[F.col(f"`{k}`").alias(a) for k, a in names.items()], "_s", "_r", "_seq")
    # one order of starts and resume points; a resume point counts the starts ahead of it
    place = 1 if strict else -1
    marks = narrow.select(*key, "_s", "_seq", F.inline(F.array(
        F.struct(F.lit(0).alias("_mark"), F.lit(1).alias("_start"), F.col("_s").alias("_at")),
        F.struct(F.lit(place).alias("_mark"), F.lit(0).alias("_start"), F.col("_r").alias("_at"))))) \
        .select(*key, "_seq", "_mark", "_start", *[F.col(f"_s.{f}").alias(a) for f, a in zip(fields, start)],
                *[F.col(f"_at.{f}").alias(a) for f, a in zip(fields, at)])
    counted = running_sums(marks, key, [*at, "_mark", *start, "_seq"], {"_n": "_start"}, block_rows)
    number = F.max(F.when(F.col("_mark") == 0, F.col("_n")))
    ahead = F.max(F.when(F.col("_mark") != 0, F.coalesce("_n", F.lit(0))))
    same = [*key, *start, "_seq"]
    linked = cut_lineage(counted.groupBy(*same).agg(
        number.alias("_n"), F.greatest(ahead, number).alias("_next"))
        .withColumns({"_next": F.col("_next") + 1,
                      "_block": F.floor((F.col("_n") - 1) / block_rows).cast("long")}))

    entered = _entries(linked, key)
    marked = _in_blocks(linked.join(entered, _match(key, "_n"), "left").select(
        *[linked[c] for c in linked.columns], entered["_e_n"].isNotNull().alias("_entry")), key, _kept)
    kept = marked.where("_entry").select(*[F.col(c).alias(f"_e{c}") for c in same])
    found = [F.col(f"`{k}`").eqNullSafe(F.col(f"_e{a}")) for k, a in names.items()] + [
        F.col(f"_s.{f}").eqNullSafe(F.col(f"_e{a}")) for f, a in zip(fields, start)]
    return matches.join(kept, [*found, F.col("_seq") == F.col("_e_seq")], "left_semi")


def _match(key: Sequence[str], number: str) -> list:
    return [F.col(k).eqNullSafe(F.col(f"_e{k}")) for k in key] + [F.col(number) == F.col("_e_n")]


def _entries(linked: DataFrame, key: list[str]) -> DataFrame:
    """``_e`` keys and ``_e_n``: the match at which each block of a key is entered."""
    def named(frame: DataFrame, number: str) -> DataFrame:
        return frame.select(*[F.col(k).alias(f"_e{k}") for k in key], F.col(number).alias("_e_n"))
    leads = cut_lineage(_in_blocks(linked, key, _exits).select(*key, "_n", F.col("_next").alias("_exit")))
    # a match that some block leads to, or the first: only these can be entries
    doors = named(leads, "_exit").distinct().unionByName(
        named(leads.where("_n = 1"), "_n")).distinct()
    jump = cut_lineage(leads.join(doors, _match(key, "_n"), "left_semi"))
    reached = named(jump.where("_n = 1"), "_n")
    while True:
        step = jump.join(reached, _match(key, "_n"), "left_semi")
        # doors behind a key's last match do not exist
        there = _null_safe(named(jump, "_n"), named(step, "_exit").distinct())
        more = cut_lineage(reached.unionByName(there).distinct())
        if more.count() == reached.count():
            return reached
        reached = more
        ahead = jump.select(*[F.col(k).alias(f"_e{k}") for k in key], F.col("_n").alias("_e_n"),
                            F.col("_exit").alias("_beyond"))
        jump = cut_lineage(jump.join(ahead, _match(key, "_exit"), "left").select(
            *key, "_n", F.coalesce("_beyond", "_exit").alias("_exit")))


def _null_safe(left: DataFrame, right: DataFrame) -> DataFrame:
    other = right.select(*[F.col(c).alias(f"_x{c}") for c in right.columns])
    return left.join(other, [F.col(c).eqNullSafe(F.col(f"_x{c}")) for c in left.columns], "left_semi")


def _in_blocks(linked: DataFrame, key: list[str], work) -> DataFrame:
    """Apply ``work`` to whole blocks, many at a time; a block's matches follow each other."""
    w = Window.partitionBy(*key, "_block").orderBy("_n")
    ordered = linked.withColumn("_new", F.row_number().over(w) == 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            begins = np.flatnonzero(np.asarray(batch.column("_new")))
            if len(begins):
                last = int(begins[-1])
                if held or last:
                    yield from work([*held, batch.slice(0, last)])
                held = [batch.slice(last)]
            elif len(batch):
                held.append(batch)
        if held:
            yield from work(held)

    return ordered.mapInArrow(run, ordered.schema).drop("_new")


def _pointers(held: list[pa.RecordBatch]):
    """The rows as one batch, the row each leads to (itself, where that is outside the block)."""
    table = pa.Table.from_batches(held).combine_chunks()
    rows = len(table)
    begins = np.flatnonzero(np.asarray(table.column("_new").combine_chunks()))
    ends = np.repeat(np.append(begins[1:], rows), np.diff(np.append(begins, rows)))
    number, follows = (np.asarray(table.column(c).combine_chunks()) for c in ("_n", "_next"))
    place = np.arange(rows)
    to = place + (follows - number)
    return table, follows, np.where(to < ends, to, place)


def _written(table: pa.Table, column: str, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    at = table.schema.get_field_index(column)
    yield from table.set_column(at, table.schema.field(at), pa.array(values)).to_batches()


def _exits(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_next`` becomes the first number outside the block that a match leads to."""
    table, follows, to = _pointers(held)
    while True:
        twice = to[to]
        if np.array_equal(twice, to):
            break
        to = twice
    yield from _written(table, "_next", follows[to])


def _kept(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_entry`` becomes true for all that the block's entry leads to."""
    table, _, to = _pointers(held)
    kept = np.array(table.column("_entry").combine_chunks())
    while True:
        kept[to[kept]] = True
        twice = to[to]
        if np.array_equal(twice, to):
            break
        to = twice
    yield from _written(table, "_entry", kept)
