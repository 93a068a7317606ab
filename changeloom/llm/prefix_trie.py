"""Conversation prefix trie, its subtree totals by time-forward processing.

A node is a distinct sequence of first turns.  Its members, and the parent of each node, come
out of aggregates over running digests; the smallest member and the depth name a node.  What
needs the tree itself, the totals over subtrees, is passed upward: nodes are sorted by reverse
level order, and each sends its totals to its parent through a priority queue ordered like
the nodes, so that a node finds what its children sent at the head of the queue.

The trie is cut into shards by weight, the number of turns in a subtree (a sum over members,
known before any tree is walked).  Nodes of weight up to ``SHARD_ROWS`` form *light* subtrees,
each a shard; the nodes above them are *heavy*, and there are at most depth * turns /
``SHARD_ROWS`` of those, however many conversations share a first turn.  Shards are passed
through first; the totals of their roots are added up per heavy parent.  Heavy nodes are cut
into pieces, runs of one smallest member over a band of ``BAND`` levels; one pass over one row
per piece carries totals across pieces, a last one fills in the nodes of each piece.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeloom.operators.blocks import running_sums
from changeloom.session import cut_lineage

#: most turns below (and in) a node of a light shard
SHARD_ROWS = 1 << 14
#: levels of one piece of the heavy part
BAND = 1 << 12
#: rows that ask for one heavy node are spread over so many join keys
SALTS = 32
#: messages a queue holds in memory before it spills
QUEUE_ROWS = 1 << 20
#: ids of one node that are joined to one text
ID_BLOCK = 1 << 12


_MEMORY = -1


class SpillingQueue:
    """A priority queue of tuples; beyond ``limit`` entries the heap goes to a sorted run.

    Runs lie in the task's own Spark scratch folder, where Spark's sorts spill too; a task
    that runs again makes its own.
    """

    def __init__(self, limit: int = QUEUE_ROWS) -> None:
        self.limit, self.heap, self.runs = limit, [], []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, (item, _MEMORY))
        if len(self.heap) > self.limit + len(self.runs):
            self._spill()

    def _spill(self) -> None:
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
        run = tempfile.TemporaryFile(dir=folder)
        rows = sorted(item for item, source in self.heap if source == _MEMORY)
        heads = [entry for entry in self.heap if entry[1] != _MEMORY]
        for at in range(0, len(rows), 4096):
            pickle.dump(rows[at:at + 4096], run)
        run.seek(0)
        self.heap = heads
        heapq.heapify(self.heap)
        self.runs.append([run, iter(())])
        self._next(len(self.runs) - 1)

    def _next(self, source: int) -> None:
        """The next entry of a run takes its place in the heap."""
        run, block = self.runs[source]
        item = next(block, None)
        if item is None:
            try:
                self.runs[source][1] = block = iter(pickle.load(run))
            except EOFError:
                run.close()
                return
            item = next(block)
        heapq.heappush(self.heap, (item, source))

    def head(self) -> tuple | None:
        return self.heap[0][0] if self.heap else None

    def pop(self) -> tuple:
        item, source = heapq.heappop(self.heap)
        if source != _MEMORY:
            self._next(source)
        return item


_TOTALS = ("children", "leaves", "saved")


def _forward(limit: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, shard, number = SpillingQueue(limit), None, 0
        for batch in batches:
            columns = {c: batch.column(c).to_pylist()
                       for c in ("shard", "level", "node", "up_level", "up_node", *_TOTALS)}
            out = {c: [] for c in _TOTALS}
            for at, level, node, up_level, up_node, children, leaves, saved in zip(
                    *columns.values()):
                if at != shard:
                    shard, number = at, number + 1
                me = (number, -level, node)
                while (head := queue.head()) is not None and head[:3] == me:
                    _, _, _, more_leaves, more_saved = queue.pop()
                    children, leaves, saved = (children + 1, leaves + more_leaves,
                                               saved + more_saved)
                if not children:
                    leaves += 1
                if up_level is not None:
                    queue.push((number, -up_level, up_node, leaves, saved))
                for column, x in zip(out.values(), (children, leaves, saved)):
                    column.append(x)
            for c in _TOTALS:
                batch = batch.set_column(batch.schema.get_field_index(c), c,
                                         pa.array(out[c], pa.int64()))
            yield batch
    return of


def pass_upward(nodes: DataFrame, limit: int = QUEUE_ROWS) -> DataFrame:
    """Time-forward pass: ``children``, ``leaves`` and ``saved`` with what came from below.

    Rows: ``shard``, (``level``, ``node``) that name a node in it, (``up_level``, ``up_node``)
    of its parent in the same shard (null: none there), and the node's own three totals.  A
    node without children counts itself as a leaf.  Shards are dealt to tasks whole and one
    after the other, each in reverse level order; the sort is Spark's and spills.
    """
    return nodes.repartition("shard").sortWithinPartitions(
        "shard", F.col("level").desc(), F.col("node")).mapInArrow(_forward(limit), nodes.schema)


def _digest_parts(*columns: Column) -> list[Column]:
    """28 bits each of a 112-bit digest.  Sums of them over up to 2^35 turns stay exact, so
    that a running digest is a running sum, which long conversations compute in blocks."""
    whole = F.md5(F.concat_ws("\x1f", *columns).cast("binary"))
    return [F.conv(F.substring(whole, k, 7), 16, 10).cast("long") for k in (1, 8, 15, 22)]


def _names(parts: list[Column]) -> Column:
    return F.struct(F.xxhash64(F.lit(0), *parts).alias("x"), F.xxhash64(F.lit(1), *parts).alias("y"))


def _sequences(turns: DataFrame) -> DataFrame:
    """``conv``, ``depth``, ``chars``, ``key`` and ``up`` (digests with and without this
    turn), ``length`` (turns of the conversation): one row per turn."""
    placed = running_sums(turns.withColumn("one", F.lit(1)), ["conv"], ["turn", "role", "text"],
                          {"depth": "one"}, totals={"length": "one"})
    sizes = [F.length(c).cast("string") for c in ("role", "text")]
    parts = _digest_parts(F.col("depth").cast("string"), *sizes, F.col("role"), F.col("text"))
    own = placed.select("conv", "depth", "length", F.length("text").cast("long").alias("chars"),
                        *[p.alias(f"h{i}") for i, p in enumerate(parts)])
    summed = running_sums(cut_lineage(own), ["conv"], ["depth"], {f"s{i}": f"h{i}" for i in range(4)})
    return summed.select(
        "conv", "depth", "length", "chars", _names([F.col(f"s{i}") for i in range(4)]).alias("key"),
        _names([F.col(f"s{i}") - F.col(f"h{i}") for i in range(4)]).alias("up"))


def _salted(frame: DataFrame, by: Column, heavy: DataFrame, key: str, how: str) -> DataFrame:
    """Join to the few heavy nodes on ``key``; the rows that ask for one are spread by ``by``."""
    every = heavy.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return frame.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")) \
        .join(every, [key, "salt"], how).drop("salt")


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's texts joined by commas; the rows come sorted by key and block."""
    def row(key, digest):
        return pa.RecordBatch.from_pylist(
            [{"key": key, "ends_sha256": digest.hexdigest()}], schema=schema)
    schema = pa.schema([("key", pa.struct([("x", pa.int64()), ("y", pa.int64())])),
                        ("ends_sha256", pa.string())])
    now, digest, done = None, None, []
    for batch in batches:
        for key, text in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if key != now:
                if digest is not None:
                    done.append({"key": now, "ends_sha256": digest.hexdigest()})
                now, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(text.encode())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)
            done = []
    if digest is not None:
        yield row(now, digest)


def end_digests(ends: DataFrame) -> DataFrame:
    """``key``, ``ends_sha256``: digest of a node's ids (``conv``), ascending, comma-joined.

    Ids are joined to texts of up to ``ID_BLOCK`` neighbouring numbers where they lie; what
    the digest of a node reads in order, bytes only, is one stream per node, as SHA-256 is.
    """
    # shifting rounds down, so blocks of negative ids are in order too
    blocks = ends.groupBy("key", F.shiftright("conv", 12).alias("block")).agg(
        F.array_join(F.array_sort(F.collect_list("conv")), ",").alias("ids"))
    return blocks.repartition("key").sortWithinPartitions("key", "block").select("key", "ids") \
        .mapInArrow(_joined_ids, "key struct<x:bigint,y:bigint>, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, shard_rows: int = SHARD_ROWS,
                band: int = BAND, queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """The nodes: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    ``turns`` has ``conv`` (long), ``turn``, ``role``, ``text``; ``convs`` the ids (``conv``)
    of all conversations, those without turns included.  Turns go by ``turn`` (null first),
    then role and text; null roles and texts are empty, repeated rows are turns of their own.
    Null ids name no conversation and take no part; other columns are ignored.  Without
    conversations there is no node, not even the root.
    """
    turns = turns.where(F.col("conv").isNotNull()).select(
        "conv", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    convs = convs.where(F.col("conv").isNotNull()).select("conv").distinct()
    rows = cut_lineage(_sequences(turns))
    root_key = _names([F.lit(0).cast("long")] * 4)
    ended = F.col("length") == F.col("depth")

    root = convs.agg(F.min("conv").alias("node"), F.count("*").alias("n_convs")) \
        .where("n_convs > 0").select(
        root_key.alias("key"), F.lit(0).cast("long").alias("level"),
        F.lit(None).cast("struct<x:bigint,y:bigint>").alias("up"), "node", "n_convs",
        F.lit(0).cast("long").alias("chars"), F.lit(None).cast("long").alias("weight"))
    nodes = cut_lineage(rows.groupBy("key", F.col("depth").alias("level")).agg(
        F.first("up").alias("up"), F.min("conv").alias("node"), F.count("*").alias("n_convs"),
        F.max("chars").alias("chars"),
        F.sum(F.col("length") - F.col("depth") + 1).alias("weight"))
        .select("key", "level", "up", "node", "n_convs", "chars", "weight").unionByName(root))

    is_heavy = F.col("weight").isNull() | (F.col("weight") > shard_rows)
    heavy_keys = nodes.where(is_heavy).select("key", F.col("node").alias("heavy_node"))
    # the parent: one of the few heavy nodes, or a light one, which has few children
    below = _salted(nodes, F.col("node"), heavy_keys.withColumnRenamed("key", "up"), "up", "left")
    inner = below.where("heavy_node IS NULL AND level > 0").drop("heavy_node").join(
        nodes.where(~is_heavy).select(F.col("key").alias("up"), F.col("node").alias("up_node")),
        "up").withColumn("tops", F.lit(False))
    outer = below.where("heavy_node IS NOT NULL OR level = 0") \
        .withColumnRenamed("heavy_node", "up_node").withColumn("tops", F.lit(True))
    placed = cut_lineage(inner.unionByName(outer).withColumn("heavy", is_heavy).select(
        "key", "level", "node", "up_node", "n_convs", "tops", "heavy",
        ((F.col("n_convs") - 1) * F.col("chars")).alias("own")))

    # the light shard of a conversation is its first node that is not heavy
    first = _salted(rows.select("conv", "depth", "key"), F.col("conv"), heavy_keys, "key", "left") \
        .where("heavy_node IS NULL").groupBy("conv").agg(F.min_by("key", "depth").alias("shard"))
    carried = ("shard", "level", "node", "up_level", "up_node", "children", "leaves", "saved",
               "key", "n_convs", "parent")
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    light = pass_upward(placed.where(~F.col("heavy")).join(
        first, F.col("node") == F.col("conv")).select(
        "shard", "level", "node", F.when(~F.col("tops"), F.col("level") - 1).alias("up_level"),
        F.when(~F.col("tops"), F.col("up_node")).alias("up_node"), zero.alias("children"),
        zero.alias("leaves"), F.col("own").alias("saved"), "key", "n_convs",
        F.col("up_node").alias("parent")), queue_rows).select(*carried)
    light = cut_lineage(light)

    # across shard roots: heavy nodes with what their light children sent
    heavy = placed.where("heavy")

    def sent(frame: DataFrame, parent: str, level: Column, *sums: Column) -> DataFrame:
        return frame.groupBy(F.col(parent).alias("node"), (level - 1).alias("level")).agg(*sums)
    sums = [F.sum(c).alias(c) for c in ("leaves", "saved")]
    from_light = sent(light.where("up_level IS NULL"), "parent", F.col("level"),
                      F.count("*").alias("children"), *sums)
    kids = sent(heavy.where("level > 0"), "up_node", F.col("level"), F.count("*").alias("kids"))
    own = cut_lineage(heavy.join(from_light, ["node", "level"], "left")
                      .join(kids, ["node", "level"], "left").select(
        "key", "node", "level", "n_convs", F.col("up_node").alias("parent"),
        F.floor(F.col("level") / band).cast("long").alias("band"),
        F.coalesce("children", zero).alias("children"), F.coalesce("kids", zero).alias("kids"),
        F.coalesce("leaves", zero).alias("leaves"),
        (F.coalesce("saved", zero) + F.col("own")).alias("saved")))
    bare = (F.col("children") + F.col("kids") == 0).cast("long")
    pieces = own.groupBy("node", "band").agg(
        F.min("level").alias("level"), F.min_by("parent", "level").alias("parent"),
        F.sum(F.col("leaves") + bare).alias("leaves"), F.sum("saved").alias("saved"))
    parents = pieces.select(F.col("node").alias("up_node"), F.col("band").alias("up_band"),
                            F.col("level").alias("up_level"))
    across = pieces.join(
        parents, (F.col("parent") == F.col("up_node"))
        & (F.floor((F.col("level") - 1) / band) == F.col("up_band")), "left").select(
        F.lit(0).alias("shard"), "level", "node", "up_level", "up_node",
        F.lit(1).cast("long").alias("children"), "leaves", "saved", "parent")
    totals = cut_lineage(pass_upward(across, queue_rows))
    from_pieces = sent(totals.where("level > 0"), "parent", F.col("level"),
                       F.count("*").alias("more"), F.sum("leaves").alias("more_leaves"),
                       F.sum("saved").alias("more_saved"))
    inside = (F.col("parent") == F.col("node")) & (F.col("level") % band != 0)
    filled = pass_upward(own.join(from_pieces, ["node", "level"], "left").select(
        F.struct(F.col("node").alias("x"), F.col("band").alias("y")).alias("shard"), "level",
        "node", F.when(inside, F.col("level") - 1).alias("up_level"),
        F.when(inside, F.col("parent")).alias("up_node"),
        (F.col("children") + F.coalesce("more", zero)).alias("children"),
        (F.col("leaves") + F.coalesce("more_leaves", zero)).alias("leaves"),
        (F.col("saved") + F.coalesce("more_saved", zero)).alias("saved"), "key", "n_convs",
        "parent"), queue_rows).select(*carried)

    turnless = convs.join(turns.select("conv").distinct(), "conv", "left_anti")
    ends = end_digests(rows.where(ended).select("key", "conv").unionByName(
        turnless.select(root_key.alias("key"), "conv")))
    return light.unionByName(filled).join(ends, "key", "left").select(
        F.col("node").alias("conv_id"), F.col("level").alias("depth"),
        F.when(F.col("level") > 0, F.col("parent")).alias("parent_conv_id"), "n_convs",
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def share_heads(turns: DataFrame, heads: int = 6, group: int = 100) -> tuple[DataFrame, DataFrame]:
    """(``turns``, ``convs``) of conversations whose beginnings are another's.

    Conversation c begins with the first h turns of conversation c - c % ``group`` (all it
    has, none where it is absent), h = crc32 of c in decimals % ``heads``; its own turns after
    its first h follow.
    """
    turns = turns.where(F.col("conv").isNotNull()).select(
        "conv", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    convs = turns.select("conv").distinct()
    own = running_sums(turns.withColumn("one", F.lit(1)), ["conv"], ["turn", "role", "text"],
                       {"place": "one"})
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    base = F.col("conv") - F.col("conv") % group
    first = own.where((F.col("conv") == base) & (F.col("place") < heads)).select(
        F.col("conv").alias("base"), "place", "role", "text")
    lent = convs.select("conv", base.alias("base"), taken.alias("taken")).join(
        first, "base").where("place <= taken")
    kept = own.where(F.col("place") > taken)
    # own turns stand behind any lent ones
    return cut_lineage(lent.select("conv", F.col("place").alias("turn"), "role", "text").unionByName(
        kept.select("conv", (F.col("place") + heads).alias("turn"), "role", "text"))), convs
