"""Connected components of a link table, by stars that merge in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import brief_shuffles, materialise, release


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """One step: every node's neighbours point to the smallest among them and the node.

    ``both_ways``: larger neighbours move (a large star); else smaller ones do (a small star).
    """
    if both_ways:
        arcs = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        arcs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = arcs.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    linked = arcs.join(least, "a")
    if both_ways:
        moved = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def _sum(edges: DataFrame) -> tuple:
    with brief_shuffles(edges.sparkSession):
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of a link; ``component`` is its smallest node.

    Links have no direction; loops, repeats and null ends are passed over. Rounds go on
    until nothing moves; their number grows with the logarithm of the longest chain. Each
    round is written to the shared folder, so a lost executor costs one round at most.
    """
    now = materialise(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    before = _sum(now)
    while before[0]:
        last, now = now, materialise(_star(_star(now, both_ways=True), both_ways=False))
        release(last)
        after = _sum(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
