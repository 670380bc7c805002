"""Connected components of a large graph by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node in edges (a, b): root is the smallest node reachable.

    Each round links every node's larger neighbours to its smallest neighbour (large
    star), then every node's smaller neighbours to the smallest (small star); the number
    of rounds grows with the logarithm of a component's size. Only (a, b) pairs move, a
    node's neighbours are never gathered, and each round is cut by a checkpoint in the
    shared folder.
    """
    e = checkpointed(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    last = None
    for _ in range(most_rounds):
        # large star: of node a, neighbours b > a go to min(a, neighbours)
        both = _both(e)
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        e = both.where("b > a").join(low, F.col("a") == F.col("n")).select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # small star: of node b, neighbours a < b and b itself go to the smallest a
        low = e.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "n")
        moved = e.join(low, F.col("b") == F.col("n")).select("m", F.explode(F.array("a", "b")).alias("x")).where("m <> x")
        e = checkpointed(moved.select(F.col("m").alias("a"), F.col("x").alias("b")).distinct())
        mark = tuple(e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.countDistinct("b")).first())
        if mark == last or mark[0] == mark[2]:
            # every larger node has one edge; a star forest once no centre is itself a leaf
            if mark == last or e.join(e.select(F.col("b").alias("c")), F.col("a") == F.col("c"), "left_semi").isEmpty():
                roots = e.select(F.col("b").alias("node"), F.col("a").alias("root"))
                return roots.union(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        last = mark
    raise RuntimeError(f"components not settled after {most_rounds} rounds")
