"""Connected components by smallest-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import checkpoint


def components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 60) -> DataFrame:
    """node, component: the smallest node reachable. Nodes without an edge don't occur; a loop counts as an edge.

    Each round a node takes the smallest label around it, then its label's label; chains shrink geometrically. Labels
    are checkpointed every round. Raises if `rounds` don't suffice, rather than return half a result.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    e = checkpoint(e.union(e.select("b", "a")).distinct())
    labels = checkpoint(e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    for _ in range(rounds):
        around = e.join(labels, e["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("m"))
        near = labels.join(around, labels["node"] == around["a"]).select("node", F.col("component").alias("was"), F.least("component", "m").alias("label"))
        up = near.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = checkpoint(near.join(up, "label", "left").select("node", "was", F.least("label", F.coalesce("next", "label")).alias("component")))
        labels = new.select("node", "component")
        if new.where("was <> component").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
