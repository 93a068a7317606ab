"""Connected components of links, by large stars and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.session import cut_lineage


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``node``, ``label`` (the least node of its component) of every node that has a link.

    ``links``: pairs (a, b), any order, repeats and loops allowed.  ``labels``: an earlier
    result, to which the links are added; the work then is on components, not on nodes.
    A large star hangs the greater neighbours of a node on its least neighbour, a small star
    the lesser ones; when neither changes a link, all links lead to the least node.  Each
    round is written to the shared folder.
    """
    if labels is not None:
        for side in ("a", "b"):
            links = links.join(labels.withColumnRenamed("node", side), side, "left").withColumn(
                side, F.coalesce("label", side)).drop("label")
    links = cut_lineage(links.where("a <> b").select(
        F.greatest("a", "b").alias("node"), F.least("a", "b").alias("to")).distinct())
    seen = _summary(links)
    while seen[0]:
        both = links.union(links.select(F.col("to").alias("node"), F.col("node").alias("to")))
        least = both.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("least"))
        large = both.where("to > node").join(least, "node").select(
            F.col("to").alias("node"), F.col("least").alias("to"))
        large = large.where("node <> to").distinct()
        small = large.join(large.groupBy("node").agg(F.min("to").alias("least")), "node")
        links = cut_lineage(
            small.select("node", F.col("least").alias("to"))
            .union(small.select(F.col("to").alias("node"), F.col("least").alias("to")))
            .where("node <> to").distinct())
        now = _summary(links)
        if now == seen:
            break
        seen = now
    found = links.select("node", F.col("to").alias("label"))
    if labels is None:
        return found
    # old labels move on to the new ones; nodes that were alone till now come along
    moved = labels.join(found.select(F.col("node").alias("label"), F.col("label").alias("new")),
                        "label", "left").select("node", F.coalesce("new", "label").alias("label"))
    return cut_lineage(moved.union(found.join(labels, "node", "left_anti")).distinct())


def _summary(links: DataFrame) -> tuple:
    """Number and sum of hashes: equal for equal sets of links."""
    return tuple(links.agg(
        F.count("*"), F.sum(F.xxhash64("node", "to").cast("decimal(38,0)"))).first())
