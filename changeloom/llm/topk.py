"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

A node's bound for a query q is q.c + |q| r.  Nodes are taken by rising bound loss (highest
bound first) for a block of queries; a query drops out of a node whose bound is below its
k-th score.  A first pass looks into the best leaf of every shard; the k-th best of all those
scores is shared with all shards before the second, full pass.

Each block of queries goes to every shard.  These copies travel by a shuffle; a task reads the
vectors of a shard, builds their tree and then takes its blocks in passing, so it holds one tree
and one block, and the driver none.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeloom.llm.arrays import table
from changeloom.session import cut_lineage

LEAF, SHARD_ROWS, BLOCK_ROWS = 64, 8192, 1024
_NONE = np.iinfo(np.int64).min


def ball_tree(points: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """Arrays of a tree: ``order`` of the points, and per node the first and last point in
    that order (``spans``), ``centers``, ``radii`` and ``children`` (itself for a leaf)."""
    exact, order = points.astype(np.float64), np.arange(len(points))
    spans, centers, radii, children = [], [], [], []

    def build(low: int, high: int) -> int:
        mine, number = order[low:high].copy(), len(spans)
        center = exact[mine].mean(axis=0)
        apart = np.sqrt(((exact[mine] - center) ** 2).sum(axis=1))
        spans.append((low, high))
        centers.append(center)
        radii.append(apart.max())
        children.append((number, number))
        if high - low > leaf and radii[number] > 0:
            far = exact[mine[int(apart.argmax())]]
            other = exact[mine[int(((exact[mine] - far) ** 2).sum(axis=1).argmax())]]
            middle = (high - low) // 2
            order[low:high] = mine[np.argpartition(exact[mine] @ (other - far), middle)]
            children[number] = build(low, low + middle), build(low + middle, high)
        return number
    build(0, len(points))
    return {"order": order, "points": points[order], "spans": np.array(spans),
            "centers": np.array(centers), "radii": np.array(radii),
            "children": np.array(children)}


def multipliable(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as floating point numbers where their inner products are exact in it."""
    most = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0))
    if most * max(1, left.shape[1]) < 2.0 ** 53:
        return left.astype(np.float64), right.astype(np.float64)
    return left, right


class Best:
    """The k best (score, smaller id first) of each query so far."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray) -> None:
        self.own, self.floor, self.k = ids, floor, k
        self.scores = np.full((len(ids), k), _NONE)
        self.ids = np.full((len(ids), k), np.iinfo(np.int64).max)

    def kth(self) -> np.ndarray:
        return np.maximum(self.scores[:, -1], self.floor)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        gains = (scores >= self.kth()[rows, None]).any(axis=1)  # the others keep what they have
        if not gains.any():
            return
        rows, scores = rows[gains], scores[gains].astype(np.int64)
        ids = np.broadcast_to(ids, scores.shape)
        scores = np.where(ids == self.own[rows, None], _NONE, scores)
        scores = np.concatenate([self.scores[rows], scores], axis=1)
        ids = np.concatenate([self.ids[rows], ids], axis=1)
        best = np.lexsort((ids, ~scores), axis=-1)[:, :self.k]  # ~x falls as x rises
        self.scores[rows] = np.take_along_axis(scores, best, axis=1)
        self.ids[rows] = np.take_along_axis(ids, best, axis=1)


def search(tree: dict[str, np.ndarray], ids: np.ndarray, queries: np.ndarray, best: Best,
           first_leaf: bool) -> None:
    """Branch and bound over one tree; ``first_leaf``: stop each query after its best leaf."""
    asked, points = multipliable(queries, tree["points"])
    norms = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
    bounds = queries.astype(np.float64) @ tree["centers"].T + norms[:, None] * tree["radii"]
    most = np.abs(tree["centers"]).max(initial=0)
    bounds += 1e-9 * (np.abs(bounds) + norms[:, None] * (1 + most)) + 1e-6
    if first_leaf:
        node = np.zeros(len(queries), dtype=np.int64)
        left, right = tree["children"].T
        rows = np.arange(len(queries))
        while True:
            low, high = left[node], right[node]
            down = np.where(bounds[rows, low] >= bounds[rows, high], low, high)
            if (down == node).all():
                break
            node = down
        for leaf in np.unique(node):
            a, b = tree["spans"][leaf]
            mine = np.flatnonzero(node == leaf)
            best.add(mine, asked[mine] @ points[a:b].T, ids[a:b])
        return
    heap = [(-bounds[:, 0].max(initial=0), 0, np.arange(len(queries)))]
    while heap:
        _, number, rows = heapq.heappop(heap)
        rows = rows[bounds[rows, number] >= best.kth()[rows]]
        if not len(rows):
            continue
        a, b = tree["spans"][number]
        children = tree["children"][number].tolist()
        if children[0] == number:
            best.add(rows, asked[rows] @ points[a:b].T, ids[a:b])
            continue
        for child in children:
            heapq.heappush(heap, (-bounds[rows, child].max(), child, rows))


_PACKED = pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("body", pa.binary())])


def _narrow(vectors: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest integers that hold them."""
    least, most = vectors.min(initial=0), vectors.max(initial=0)
    return vectors.astype(next(kind for kind in (np.int8, np.int16, np.int32, np.int64)
                               if np.iinfo(kind).min <= least and most <= np.iinfo(kind).max))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All queries of each (dim, block) as one value: ids with vectors."""
    def one(dim, block, ids, vectors):
        ids, vectors = np.array(ids, np.int64), np.array(vectors, np.int64).reshape(len(ids), dim)
        return dim, block, pickle.dumps((ids, _narrow(vectors)))

    now, ids, vectors = None, [], []
    for batch in batches:
        for row in batch.to_pylist():
            if (row["dim"], row["block"]) != now:
                if ids:
                    yield table(_PACKED, *zip(one(*now, ids, vectors)))
                now, ids, vectors = (row["dim"], row["block"]), [], []
            ids.append(row["id"])
            vectors.append(row["vector"])
    if ids:
        yield table(_PACKED, *zip(one(*now, ids, vectors)))


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


#: in place of a block's number: a vector of the shard; it sorts before the blocks
_VECTOR = -1


def _searched(k: int, first_leaf: bool):
    """Of each (dim, shard), the vectors and then the blocks of queries that meet them."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vectors, tree = None, [], [], None
        for batch in batches:
            at = np.stack([batch.column(c).to_numpy().astype(np.int64)
                           for c in ("dim", "shard", "block")], axis=1)
            cuts = np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(at)]):
                if low == high:
                    continue
                dim, shard, block = at[low].tolist()
                if block == _VECTOR:
                    if (dim, shard) != now:
                        now, ids, vectors, tree = (dim, shard), [], [], None
                    ids.append(batch.column("id").slice(low, high - low).to_numpy())
                    flat = batch.column("vector").slice(low, high - low).flatten().to_numpy()
                    vectors.append(flat.reshape(high - low, dim))
                    continue
                if (dim, shard) != now:  # a shard without vectors of this length
                    continue
                if tree is None:
                    tree, vectors = ball_tree(np.concatenate(vectors)), []
                    ids = np.concatenate(ids)[tree["order"]]
                for n in range(low, high):
                    own, queries = pickle.loads(batch.column("body")[n].as_py())
                    known = dict(batch.column("floors")[n].as_py() or ())
                    floor = np.array([known.get(int(q), _NONE) for q in own], dtype=np.int64)
                    best = Best(own, k, floor)
                    search(tree, ids, queries.astype(np.int64), best, first_leaf)
                    keep = (best.scores > _NONE) & (best.scores >= floor[:, None])
                    yield table(_FOUND, np.repeat(own, k)[keep.ravel()], best.ids[keep],
                                best.scores[keep])
    return of


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id",
          embedding: str = "embedding", scale: int = 256, shard_rows: int = SHARD_ROWS,
          block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` of each query's k best rows.

    Components become floor(scale * x); scores are integer inner products and must fit into
    a long.  Ties go to the smaller id.  Rows with the query's id are not candidates of it.
    Null ids, null vectors and vectors with a null or non-finite component take no part, and
    only vectors of one length are compared; the product of empty ones is 0.  Repeated rows
    are candidates each, and repeated query rows search each and share the k ranks.  A query
    without candidates gives no rows.
    """
    given = vectors.select(vectors[f"`{key}`"].alias("id"), is_query.alias("asks"),
                           vectors[f"`{embedding}`"].alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)
                    & (F.abs(x) < float("inf")))
    given = given.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(fine).select(
        "id", "asks", F.size("v").alias("dim"),
        F.transform("v", lambda x: F.floor(x.cast("double") * scale)).alias("vector"))
    given = cut_lineage(given)
    n, n_asking = given.agg(F.count("*"), F.count_if("asks")).first()
    shards, blocks = n // shard_rows + 1, n_asking // block_rows + 1

    def part(column: str, parts: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(parts))
    asking = given.where("asks").select("dim", part("id", blocks).alias("block"), "id", "vector")
    asking = cut_lineage(asking.repartition("dim", "block").sortWithinPartitions(
        "dim", "block", "id").mapInArrow(_pack, "dim int, block long, body binary"))
    no_body, no_floors = F.lit(None).cast("binary"), F.lit(None).cast("map<bigint,bigint>")
    shard_vectors = given.select(
        "dim", part("id", shards).alias("shard"), F.lit(_VECTOR).cast("long").alias("block"), "id",
        "vector", no_body.alias("body"), no_floors.alias("floors"))
    no_id, no_vector = F.lit(None).cast("long"), F.lit(None).cast("array<bigint>")
    every = F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))

    def met(asked: DataFrame) -> DataFrame:
        """Each block goes to every shard of its length.  A join would be planned by the size of
        the blocks before they are copied, and gather the copies in the driver."""
        sent = asked.select("dim", F.explode(every).alias("shard"), "block", no_id.alias("id"),
                            no_vector.alias("vector"), "body", "floors")
        return shard_vectors.union(sent).repartition("dim", "shard").sortWithinPartitions(
            "dim", "shard", "block", "id")
    found = "query_id long, vec_id long, score long"
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    pilot = met(asking.withColumn("floors", no_floors)).mapInArrow(_searched(k, True), found)
    ranked = pilot.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k)
    floors = ranked.select(part("query_id", blocks).alias("block"),
                           F.struct("query_id", "score").alias("one"))
    floors = floors.groupBy("block").agg(F.map_from_entries(F.collect_list("one"))
                                         .alias("floors"))
    full = met(asking.join(floors.hint("merge"), "block", "left"))
    scored = full.mapInArrow(_searched(k, False), found)
    return scored.withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
