"""Connected components of an edge table by alternating large-star and small-star steps, all on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm.shared import cut_tidily as cut  # a round is read from its files only
from assayframe.llm.shared import drop_cut


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links the larger (or smaller) neighbours of each node, and the node, to the least of them.

    The least neighbour is an aggregate, so a node with very many links costs one pre-aggregated row per task; the
    join that follows is an equi-join that Spark may split.
    """
    ways = _both(edges) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = ways.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = ways.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, most: int = 50) -> DataFrame:
    """node and component (its smallest node) for every node of edges (a, b); nodes are longs.

    Edge cases: no edges give no rows; loops and repeated edges don't matter.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    state = None
    for _ in range(most):
        step = cut(_star(_star(now, True), False), "cc")
        drop_cut(now)
        now = step
        # A star forest: every node has one link, and no centre has a link to a lesser node.
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        state = tuple(seen)
    raise RuntimeError("components did not settle")
