"""Connected components of links by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyflow.llm.common import stored


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, label`` for every node of ``links(a, b)``; the label is the smallest node reachable.

    Each round points every node at its smallest neighbour, halves the paths and
    contracts the links onto the nodes pointed at.  Only links between different
    nodes survive, so few rounds are needed; joins read stored tables, which lets
    Spark split a hub's rows.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    labels = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct().select("node", F.col("node").alias("label"))
    labels = stored(labels, "labels")
    for _ in range(max_rounds):
        if edges.isEmpty():
            return labels
        both = edges.union(edges.select("v", "u"))
        parent = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("up")), "parents")
        above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
        parent = stored(parent.join(above, "up").select("node", "top"), "parents")
        labels = stored(labels.join(parent.withColumnRenamed("node", "label"), "label", "left")
                        .select("node", F.coalesce("top", "label").alias("label")), "labels")
        u = parent.select(F.col("node").alias("u"), F.col("top").alias("x"))
        v = parent.select(F.col("node").alias("v"), F.col("top").alias("y"))
        edges = stored(edges.join(u, "u").join(v, "v").where("x <> y")
                       .select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "links")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
