"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.lineage import cut


def connected_components(edges: DataFrame, a: str = "source", b: str = "target") -> DataFrame:
    """(node, component) for every node that has an edge; component is its smallest node.

    Each round every node points to its smallest neighbour (a map-side
    combined min), pointers are shortened twice, and the edges are rewritten
    between the nodes pointed to. Edges shrink geometrically, so rounds are
    logarithmic and a node of huge degree is never gathered in one task.
    """
    live = cut(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null").distinct())
    labels = live.select(F.col("x").alias("node")).union(live.select(F.col("y").alias("node"))).distinct().withColumn("component", F.col("node"))
    live = live.where("x <> y")
    while not live.isEmpty():
        both = live.union(live.select(F.col("y").alias("x"), F.col("x").alias("y")))
        up = both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("v"), F.least("x", "m").alias("to"))
        up = cut(up)
        for _ in range(2):
            step = up.select(F.col("v").alias("to"), F.col("to").alias("next"))
            up = up.join(step, "to", "left").select("v", F.coalesce("next", "to").alias("to"))
        up = cut(up)
        to_x, to_y = up.select(F.col("v").alias("x"), F.col("to").alias("x2")), up.select(F.col("v").alias("y"), F.col("to").alias("y2"))
        live = cut(live.join(to_x, "x").join(to_y, "y").select(F.col("x2").alias("x"), F.col("y2").alias("y")).where("x <> y").distinct())
        labels = labels.join(up.select(F.col("v").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = cut(labels)
    return labels
