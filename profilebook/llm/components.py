"""Connected components of an edge table by smallest-label propagation with label jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilebook.llm.common import landed


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node reachable, for every node of ``edges`` (u, v).

    Each round a node takes the smallest label among its own and its neighbours', then the label of that label.  A label
    is always a node of the same component and only falls, so when nothing changes all nodes of a component have its
    smallest node.  Every round is written to the shared folder; only the number of changes reaches the driver.
    """
    both = landed(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct(), "edges")
    labels = landed(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("component").alias("near"))
        step = labels.join(near, F.col("node") == F.col("u")).select("node", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("j_node"), F.col("component").alias("j_component"))
        step = landed(step.join(jump, F.col("mid") == F.col("j_node"), "left").select(
            "node", "old", F.coalesce(F.least("mid", "j_component"), F.col("mid")).alias("component")), "labels")
        labels = step.select("node", "component")
        if step.filter("old <> component").isEmpty():
            return labels
