"""Connected components of a graph that only Spark holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.shared import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each end of `links` (a long, b long); component is the smallest node that can be reached.

    Each round every node takes the smallest label among its own and its neighbours', then the label of that label, so
    that long chains shrink by powers of two. The labels of a round are a table in the shared folder; the driver sees only
    how many changed. A node with very many links is combined before the shuffle (minimum) and its side of the join is split
    by adaptive execution. No links: an empty table.
    """
    pairs = links.where("a <> b").select("a", "b")
    both = written(pairs.union(pairs.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    while True:
        near = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("seen"))
        )
        lower = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "seen").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("further"))
        step = written(lower.join(jump, "low", "left").select("node", "old", F.least("low", "further").alias("component")), "labels")
        labels = step.select("node", "component")
        if step.where("old <> component").limit(1).count() == 0:
            return labels
