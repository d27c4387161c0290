"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Written down, so that the join is one of two plain shuffles, of which Spark splits the rows of a hub.
    least = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m")))
    moved = both.filter("b > a").join(least, F.col("a") == F.col("k")).select(F.col("m").alias("a"), "b")
    return moved.filter("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # Here a < b: b's smaller neighbours and b itself all move to the least of them.
    edges = cut_lineage(edges)
    least = cut_lineage(edges.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("k"), "m"))
    moved = edges.join(least, F.col("b") == F.col("k")).select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b"), F.col("b").alias("c"))
    # One pass over the join gives both moves.
    ends = moved.select("a", F.explode(F.array("b", "c")).alias("b"))
    return ends.filter("a < b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node with an edge; `edges` has long columns a and b. `root` is the least node reachable.

    Each round halves distances at least, so the number of rounds grows with the logarithm of the longest path.
    Only a count and a checksum reach the driver; every round is written to the checkpoint folder.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    edges = cut_lineage(edges)
    before = _state(edges)
    for _ in range(max_rounds if before[0] else 0):
        edges = cut_lineage(_small_star(_large_star(edges)))
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
