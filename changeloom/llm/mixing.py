"""Mixing sources to target weights: exponential keys, sorted within each source.

A document of weight w gets the key -ln(u)/w, u uniform from its id.  Taking a source's
documents by rising key is sampling without replacement in proportion to w.  The budget of
a source first pays for whole passes over it; what is left buys documents by key.
Prefix sums go by key ranges: sums per range, then sums within one range, so that no task
holds a whole source.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeloom.llm.arrays import table
from changeloom.session import cut_lineage

#: rows of a source that share one key range
RANGE_ROWS = 2_000
SALTS = 32


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"),
                           lambda w: w != "")).cast("long")


def uniform(key: Column) -> Column:
    """A number in (0, 1) from the md5 of the key's text; the same in every run."""
    bits = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / float(1 << 52)


def targets(sources: DataFrame, weights: Sequence[int], limit: int) -> DataFrame:
    """``sources`` (none, source, source_size) with ``target``, in words.

    Sources by code point, null last, weigh as ``weights`` says, over and over.  They share
    the sum of all sizes; no target exceeds ``limit`` times its source.  With level L each
    source gets min(limit * size, L * weight); L is the greatest of the levels that come
    from fixing the first k sources, by rising limit * size / weight, at their limit.
    """
    place = F.row_number().over(Window.orderBy("none", "source")) - 1
    weigh = F.get(F.array(*[F.lit(float(w)) for w in weights]), place % len(weights))
    up = Window.orderBy("ratio", "none", "source")
    rows = sources.select("*", weigh.alias("w")).select(
        "*", (limit * F.col("source_size")).alias("most"),
        (limit * F.col("source_size") / F.col("w")).alias("ratio"))
    whole = Window.partitionBy()
    level = ((F.sum("source_size").over(whole)
              - (F.sum("most").over(up.rowsBetween(Window.unboundedPreceding, 0))
                 - F.col("most"))).cast("double")
             / F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing)))
    return (rows.withColumn("level", level)
            .withColumn("target", F.least(F.col("most").cast("double"),
                                          F.max("level").over(whole) * F.col("w")))
            .select("none", "source", "source_size", "target"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), limit: int = 3,
        labels: DataFrame | None = None, carry: Sequence[str] | None = None,
        key: str = "doc_id", source: str = "source", text: str = "text",
        range_rows: int = RANGE_ROWS, whole: bool = False) -> DataFrame:
    """``row`` (the input), ``size``, ``source_size``, ``target``, ``taken``.

    ``taken`` counts words: whole passes of the document, plus the document itself when it
    is drawn, or its first words when it is the one that the budget ends in; so a source
    takes its target rounded down.  ``whole``: that one is drawn or left as a whole, so that
    ``taken`` is a multiple of ``size``, a source meets its target to within one document and
    the sources together the sum of their targets, see :func:`round_up`.  ``labels`` (key, quality) weigh documents, see
    :func:`quality_weights`; without them all weigh 1.  ``carry``: columns in ``row``, all by
    default; only these travel.  Null text: no words.  Null source: a source of its own, the
    last.  Null ids draw one number together; ties go by id and size, and repeated rows are
    rows of their own.
    """
    rows = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in carry or docs.columns]).alias("row"),
        docs[f"`{key}`"].alias("id"), docs[f"`{source}`"].isNull().alias("none"),
        F.coalesce(docs[f"`{source}`"].cast("string"), F.lit("")).alias("source"),
        n_words(docs[f"`{text}`"]).alias("size"))
    if labels is None:
        rows = rows.withColumn("w", F.lit(1.0))
    else:  # labels grow with the documents: never broadcast
        rows = rows.join(quality_weights(labels, key).hint("merge"), "id", "left")
        rows = rows.fillna(1.0, ["w"])
    rows = rows.withColumn("draw", -F.log(uniform(F.col("id"))) / F.col("w"))
    per = rows.groupBy("none", "source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("n"), F.min("w").alias("low"))
    wanted = per.join(targets(per.select("none", "source", "source_size"), weights, limit)
                      .drop("source_size"), ["none", "source"])
    wanted = wanted.withColumn("budget", F.floor("target"))
    if whole:
        cut = mix(docs, weights, limit, labels, [source], key, source, text, range_rows)
        wanted = wanted.join(_to_borders(cut, source), ["none", "source"], "left").withColumn(
            "budget", F.col("budget") + F.coalesce("more", F.lit(0))).drop("more")
    # rows of a large source meet its target in SALTS places
    salted = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(
        salted, ["none", "source", "salt"]).drop("salt")
    # with the lowest weight of its source the keys spread over (0, 1)
    spread = 1 - F.exp(-F.col("draw") * F.col("low"))
    n_ranges = F.floor(F.col("n") / range_rows) + 1
    rows = rows.withColumn("range", F.least(F.floor(spread * n_ranges), n_ranges - 1))
    sums = rows.groupBy("none", "source", "range").agg(F.sum("size").alias("in_range"))
    below = Window.partitionBy("none", "source").orderBy("range")
    sums = sums.withColumn("below", F.sum("in_range").over(below) - F.col("in_range"))
    rows = rows.join(sums.drop("in_range"), ["none", "source", "range"])
    within = (Window.partitionBy("none", "source", "range").orderBy("draw", "id", "size")
              .rowsBetween(Window.unboundedPreceding, 0))
    before = F.col("below") + F.sum("size").over(within) - F.col("size")
    budget = F.col("budget")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    out = rows.withColumns({"before": before, "passes": passes})
    rest = budget - F.col("passes") * F.col("source_size") - F.col("before")
    taken = (F.col("passes") * F.col("size")
             + F.greatest(F.lit(0), F.least(F.col("size"), rest)))
    return out.select("row", "size", "source_size", "target", taken.cast("long").alias("taken"))


def round_up(sizes: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Which documents to take whole, of those that ``parts`` words are wanted of.

    From the longest on, each is taken or left as brings the sum nearer to that of the parts;
    then one or two answers at a time are turned as long as that brings it nearer still.
    """
    up, over = np.zeros(len(sizes), dtype=bool), 0
    for i in np.argsort(-sizes, kind="stable"):
        up[i] = abs(over + sizes[i] - parts[i]) <= abs(over - parts[i])
        over += (sizes[i] if up[i] else 0) - parts[i]
    while len(sizes):
        change = np.append(np.where(up, -sizes, sizes), 0)  # the last: turn only one
        order = np.argsort(change, kind="stable")
        near = np.searchsorted(change[order], -over - change)
        at = np.clip(np.stack([near - 1, near]), 0, len(order) - 1)
        other = order[at]
        after = np.abs(over + change + change[other])
        after[other == np.arange(len(order))] = abs(over)
        best = np.unravel_index(after.argmin(), after.shape)
        if after[best] >= abs(over):
            break
        turned = [i for i in (best[1], other[best]) if i < len(sizes)]
        over += change[turned].sum()
        up[turned] = ~up[turned]
    return up


_MORE = pa.schema([("none", pa.bool_()), ("source", pa.string()), ("more", pa.int64())])


def _to_borders(cut: DataFrame, source: str) -> DataFrame:
    """``none``, ``source``, ``more``: words to add to a budget so that it ends with a document.

    One row per source whose budget ends inside of one; a single task reads these rows.
    """
    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            rows = pa.Table.from_batches(held)
            sizes, parts = rows["size"].to_numpy(), rows["part"].to_numpy()
            more = np.where(round_up(sizes, parts), sizes, 0) - parts
            yield table(_MORE, rows["none"].combine_chunks(), rows["source"].combine_chunks(),
                        more)

    name = F.col("row")[source]
    inside = cut.where("size > 0").select(
        name.isNull().alias("none"), F.coalesce(name.cast("string"), F.lit("")).alias("source"),
        "size", (F.col("taken") % F.col("size")).alias("part")).where("part > 0")
    return cut_lineage(inside.repartition(1).sortWithinPartitions("none", "source").mapInArrow(
        settled, "none boolean, source string, more long"))


def quality_weights(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """``id`` and ``w``: 2 for documents labelled good, 0.5 for poor; good wins a conflict."""
    return labels.groupBy(labels[f"`{key}`"].alias("id")).agg(
        F.when(F.max("quality") == 1, 2.0).when(F.max("quality") == 0, 0.5).otherwise(1.0)
        .alias("w"))


def written_out(mixed: DataFrame, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """The mix as documents: each row as often as it was taken, cut where the budget ends.

    The cut row keeps its first words, joined by one space, and its own character count; a
    mix of whole documents (``whole``) has none.
    """
    whole, part = F.floor(F.col("taken") / F.col("size")), F.col("taken") % F.col("size")
    copies = F.when(F.col("size") > 0, whole + (part > 0).cast("int")).otherwise(0)
    each = mixed.withColumns({"part": part, "whole": whole}).where(copies > 0).select(
        "row", "part", "whole",
        F.explode(F.sequence(F.lit(1).cast("long"), copies.cast("long"))).alias("copy"))
    cut = F.col("copy") > F.col("whole")
    words = F.filter(F.split(F.col("row")[text], r"[\x20\x09-\x0D]+"), lambda w: w != "")
    new = F.when(cut, F.array_join(F.slice(words, 1, F.col("part").cast("int")), " ")) \
        .otherwise(F.col("row")[text])
    names = mixed.schema["row"].dataType.names
    each = each.select(*[(new if c == text else F.col("row")[c]).alias(c) for c in names],
                       cut.alias("__cut"))
    if chars in names:
        kept = F.when(F.col("__cut"), F.length(F.col(text)).cast("long")).otherwise(F.col(chars))
        each = each.withColumn(chars, kept.cast(mixed.schema["row"].dataType[chars].dataType))
    return each.drop("__cut")
