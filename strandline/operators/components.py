"""Connected components of a table of edges, in rounds whose tables are written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, root): the least node of each node's component; ``edges`` has a and b, loops are allowed.

    A round links each node's greater neighbours to its least one, then each node and its
    lesser neighbours to the least of them: paths halve, so rounds grow with the logarithm
    of the longest path. Only counts come to the driver.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        far = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        down = far.unionByName(least.select("a", F.col("m").alias("b")).where("a <> b")).distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        near = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = cut(near.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        same = after.count() == e.count() and after.join(e, ["a", "b"], "left_anti").limit(1).count() == 0
        e = after
        if same:
            return nodes.join(e.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
