"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.llm.common import few, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: bigint); the component is its least node.

    Each round takes the least label among a node and its neighbours and then
    the label of that label, so paths halve; labels are kept as a table per
    round.  Joins meet one row per node on one side, so hubs can be split.
    """
    both = stored(few(edges.select("a", "b").union(edges.select("b", "a")).distinct(), 2 * edges.count()), "edges")
    n = both.count()
    labels = stored(few(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), n), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        step = labels.join(near, "node").select("node", F.least("component", "m").alias("c"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("further"))
        after = stored(few(step.join(jump, "c").select("node", F.least("c", "further").alias("component"), "was"), n), "labels")
        labels = after.select("node", "component")
        if after.where("component <> was").isEmpty():
            return labels
