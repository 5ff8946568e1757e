"""Connected components of an edge table by alternating large and small stars.

Each round is a few joins and aggregations of the edges on their end points; minima are combined
before the shuffle, so a node with many edges is one row per task there, and the minima of such nodes
come back to their edges by broadcast (``shared.lookup``).  A round's edges go to the shared folder,
which ends their lineage.  The edges converge to one star per component, around its
smallest node, after a number of rounds that grows with the logarithm of the nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tindra.llm import shared

MOST_ROUNDS = 60


def _large(e: DataFrame, total: int) -> DataFrame:
    both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("n"))
    return shared.lookup(both.where("b > a"), least, ["a"], "n", 2 * total).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(e: DataFrame, total: int) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = shared.lookup(down, least, ["a"], "n", total).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node of ``edges`` (columns a, b: long).

    Loops and repeated edges do no harm; nodes without an edge to another are not returned."""
    current = shared.settle(edges.where("a <> b"), "edges")
    current = shared.settle(_small(current, current.count()), "edges")
    seen = None
    for _ in range(MOST_ROUNDS):
        wide = shared.settle(_large(current, current.count()), "edges")
        current = shared.settle(_small(wide, wide.count()), "edges")
        # whole sums of 64-bit hashes of two kinds: other edges with the same three numbers do not occur
        kinds = (F.sum(F.xxhash64(*c).cast("decimal(38,0)")) for c in (("a", "b"), ("b", "a")))
        state = current.agg(F.count("*"), *kinds).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not converge")
    stars = current.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return stars.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
