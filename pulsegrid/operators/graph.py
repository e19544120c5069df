"""Connected clusters of the kept nodes of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.sources.shared import shared_dir


def _written(df: DataFrame, name: str) -> DataFrame:
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clusters(nodes: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, cluster): cluster is the smallest node that edges (src, dst, either way) among
    the kept nodes reach. Each round takes the smallest label of a node's neighbours and
    then that label's own label, so rounds grow with the logarithm of the longest path."""
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    kept = nodes.select("node").distinct()
    both = both.join(kept.withColumnRenamed("node", "src"), "src", "left_semi").join(kept.withColumnRenamed("node", "dst"), "dst", "left_semi")
    both = _written(both.distinct(), "graph")
    labels = _written(kept.withColumn("cluster", F.col("node")), "labels")
    for _ in range(rounds):
        near = both.join(labels, both["dst"] == labels["node"]).groupBy("src").agg(F.min("cluster").alias("near"))
        low = labels.join(near, labels["node"] == near["src"], "left").select("node", "cluster", F.least("cluster", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("cluster").alias("jump"))
        nxt = _written(low.join(up, "low").select("node", F.least("low", "jump").alias("next"), (F.least("low", "jump") < F.col("cluster")).alias("moved")), "labels")
        labels = nxt.select("node", F.col("next").alias("cluster"))
        if not nxt.where("moved").head(1):
            return labels
    raise RuntimeError(f"clusters did not settle in {rounds} rounds")
