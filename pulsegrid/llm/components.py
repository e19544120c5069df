"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import hinted, written

#: Nodes whose smallest neighbours are broadcast; with more they are joined as any table.
BROADCAST_NODES = 500_000


def _smallest(low: DataFrame) -> DataFrame:
    """The smallest neighbours, written: a join with them then is a broadcast, or a plain one
    of which Spark can split the key of a node with very many neighbours."""
    return hinted(written(low, "smallest"), BROADCAST_NODES)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
    low = _smallest(low)
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    low = _smallest(down.groupBy("a").agg(F.min("b").alias("low")))
    moved = down.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.union(low.select("a", F.col("low").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge to another node; root is the smallest
    node reachable. edges has columns a and b (long, not null); repeated edges, loops and
    either direction are fine; an empty table gives an empty one.

    Each round is written to the shared folder; the rounds end when one leaves the edges as
    they were. Rounds needed grow with the logarithm of the longest chain.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    for _ in range(rounds):
        moved = written(_small_star(written(_large_star(edges), "edges")), "edges")
        if moved.count() == edges.count() and not moved.join(edges, ["a", "b"], "left_anti").head(1):
            return moved.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = moved
    raise RuntimeError(f"components did not settle in {rounds} rounds")
