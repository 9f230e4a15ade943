"""Connected components of a graph given as edges, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cmdlode.session import discard, stored

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours move to the least node among it and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours move to the least of these; ``a > b`` holds."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``a, b`` (any order, repeats allowed) -> ``node, root``, without nodes that are their own root.

    ``root`` is the least node reachable. Aggregates are combined before they are
    shuffled, so a node with very many neighbours is no bottleneck; each round is
    written to the shared folder, which cuts the lineage. The number of rounds grows
    with the logarithm of the longest path.
    """
    current = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    for _ in range(MAX_ROUNDS):
        children = current.groupBy(F.col("a").alias("child")).agg(F.count("*").alias("n"))
        torn = children.where("n > 1").union(current.join(children, F.col("b") == F.col("child")).select("b", "n"))
        if torn.isEmpty():  # every node has one root, and no root has one
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, current = current, stored(_small_star(_large_star(current)), "edges")
        discard(before)
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
