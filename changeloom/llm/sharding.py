"""Sharding: groups of equal texts into shards of near equal bytes, best fit decreasing.

Groups that matter for the fit are units of their own; the many small ones are bundled by
hash.  So at most ``shards * SHARE + BUNDLES`` units and a few parts are packed, however
many documents there are, and the packing runs in one short task.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changeloom.session import cut_lineage

#: a group of at least 1 / SHARE of a shard's bytes is a unit of its own
SHARE = 500
BUNDLES = 8192
#: rows of a unit that are numbered together
NUMBERED = 50_000


class FreeSpace:
    """Free space of the open shards in a balanced search tree (a treap)."""

    def __init__(self, seed: int = 7) -> None:
        self.root, self.random = None, random.Random(seed)

    def add(self, key: tuple[int, int]) -> None:
        low, high = self._split(self.root, key)
        node = [key, self.random.random(), None, None]
        self.root = self._join(self._join(low, node), high)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Take out the smallest (free, shard) with free >= size."""
        node, best = self.root, None
        while node:
            if node[0] >= (size, -1):
                best, node = node[0], node[2]
            else:
                node = node[3]
        if best is not None:
            low, rest = self._split(self.root, best)
            _, high = self._split(rest, (best[0], best[1] + 1))
            self.root = self._join(low, high)
        return best

    def _split(self, node, key):
        if not node:
            return None, None
        if node[0] < key:
            node[3], high = self._split(node[3], key)
            return node, high
        low, node[2] = self._split(node[2], key)
        return low, node

    def _join(self, low, high):
        if not low or not high:
            return low or high
        if low[1] > high[1]:
            low[3] = self._join(low[3], high)
            return low
        high[2] = self._join(low, high[2])
        return high


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """The shard of each size, given in falling order; a new shard where none has room."""
    free, out, opened = FreeSpace(), [], 0
    for size in sizes:
        room = free.tightest(size)
        if room is None:
            room, opened = (max(capacity, size), opened), opened + 1
        out.append(room[1])
        free.add((room[0] - size, room[1]))
    return out


def fewest_bytes(sizes: list[int], shards: int) -> list[int]:
    """Best fit decreasing with nearly the least capacity that needs only ``shards``.

    A size above the mean of the shards that are left has a shard of its own, so that it does
    not set the capacity of the others.  Capacity mean + largest always does: were a size to
    fit nowhere, every shard would hold more than the mean.
    """
    alone, rest = 0, sum(sizes)
    while alone < min(len(sizes), shards - 1) and sizes[alone] * (shards - alone) > rest:
        rest -= sizes[alone]
        alone += 1
    if alone:
        return [*range(alone), *[alone + s for s in fewest_bytes(sizes[alone:], shards - alone)]]
    if not sizes:
        return []
    low = max(-(-sum(sizes) // shards), sizes[0])
    high = low + sizes[0]
    best = best_fit(sizes, high)
    while high - low > high // 20_000:
        middle = (low + high) // 2
        packed = best_fit(sizes, middle)
        if max(packed) < shards:
            best, high = packed, middle
        else:
            low = middle + 1
    return best


def shard_by_bytes(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text",
                   extra: int = 8) -> DataFrame:
    """``row`` (the input), ``size``, ``shard`` and ``slot`` (gapless from 0 in a shard).

    Size: UTF-8 bytes of the text plus ``extra``; null text counts as empty.  Rows of equal
    text share a shard, unless they fill more than one: then they are dealt, by a hash of
    the row's number, into parts of about a quarter shard, whatever ids they share.  Repeated
    rows are rows of their own; fewer rows than shards leave shards empty; no rows give no
    rows.  The rows, numbered, are written to the shared folder once.
    """
    body = F.coalesce(docs[f"`{text}`"], F.lit(""))
    rows = cut_lineage(docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
        docs[f"`{key}`"].alias("id"), F.unhex(F.md5(body)).alias("group"),
        (F.octet_length(body) + extra).cast("long").alias("size"),
        F.monotonically_increasing_id().alias("number")))
    light = rows.select("number", "group", "size")
    groups = light.groupBy("group").agg(F.sum("size").alias("bytes"))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    fair = max(1, -(-total // shards))
    # at most shards * SHARE rows, as they add up to at most total
    large = groups.where(F.col("bytes") * SHARE >= fair).select(
        "group", F.when(F.col("bytes") > fair, F.ceil(F.col("bytes") * 4 / F.lit(fair)))
        .otherwise(1).cast("long").alias("parts"))

    def with_unit(frame: DataFrame) -> DataFrame:
        joined = frame.join(F.broadcast(large), "group", "left")
        is_large = F.col("parts").isNotNull()
        return joined.withColumns({
            "unit": F.when(is_large, F.col("group")).otherwise(F.lit(b"")),
            "part": F.when(is_large, F.pmod(F.xxhash64("number", F.lit(1)), F.col("parts")))
            .otherwise(F.pmod(F.xxhash64("group"), F.lit(BUNDLES)))}).drop("group", "parts")
    units = with_unit(light).groupBy("unit", "part").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("n"))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = list(frames)
        if not got:
            return
        got = pd.concat(got).sort_values(["bytes", "unit", "part"],
                                         ascending=[False, True, True])
        got["shard"] = fewest_bytes(got["bytes"].tolist(), shards)
        yield got[["unit", "part", "n", "shard"]]
    placed = units.repartition(1).mapInPandas(pack, "unit binary, part long, n long, shard int")
    placed = placed.withColumn("subs", F.floor(F.col("n") / NUMBERED) + 1).drop("n")

    def with_shard(frame: DataFrame) -> DataFrame:
        joined = with_unit(frame).join(F.broadcast(placed), ["unit", "part"])
        return joined.withColumn("sub", F.pmod(F.xxhash64("number", F.lit(2)), F.col("subs")))
    counts = with_shard(light).groupBy("shard", "unit", "part", "sub").agg(
        F.count("*").alias("n"))
    order = Window.partitionBy("shard").orderBy("unit", "part", "sub")
    counts = counts.withColumn("base", F.sum("n").over(order) - F.col("n")).drop("n")
    numbered = with_shard(rows).join(counts, ["shard", "unit", "part", "sub"])
    slot = F.row_number().over(Window.partitionBy("shard", "unit", "part", "sub")
                               .orderBy("id", "number")) - 1
    return numbered.select("row", "size", "shard",
                           (F.col("base") + slot).cast("long").alias("slot"))
