"""Connected components of a graph held in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label): the least node of each node's component; ``edges`` has a and b.

    Each round a node takes the least label around it, then the label of its label. The
    rounds' tables are written, so a lost executor costs one round at most; counts only
    come to the driver.
    """
    both = C.cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = C.cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"))
    for _ in range(most_rounds):
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        best = C.cut(labels.join(around, labels.node == around.a).select("node", "label", F.least("label", "near").alias("new")))
        of = best.select(F.col("node").alias("new"), F.col("new").alias("newer"))
        jumped = C.cut(best.join(of, "new", "left").select("node", F.col("label").alias("old"), F.least("new", F.coalesce("newer", "new")).alias("label")))
        labels = jumped.select("node", "label")
        if not jumped.where("old <> label").limit(1).count():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
