"""Connected components of a distributed graph by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.session import cut


def components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node reachable) for all nodes of edges (a, b); nothing is collected, each round is written.

    A round gives every node the smallest label among its neighbours', then the label of that label; long chains shrink by
    more than half a round. Repeated edges count once, loops and edges with a null end not at all; an empty graph gives an empty table.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").where("a <> b").distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label"))
    while True:
        far = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        stepped = labels.join(far, labels.node == far.a, "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        stepped = cut(stepped)
        up = stepped.select(F.col("node").alias("p"), F.col("label").alias("top"))
        new = cut(stepped.join(up, stepped.label == up.p, "left").select("node", "old", F.least("label", F.coalesce("top", "label")).alias("label")))
        if not new.where("old <> label").limit(1).count():
            return new.select("node", "label")
        labels = new.select("node", "label")
