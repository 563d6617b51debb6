"""Connected components by the smallest label, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.operators.keys import staged


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, label): the smallest node of each node's component, for nodes of edges (a, b).

    Each round hangs every node below the smallest label of its neighbours and
    then below that label's own, so chains shorten by half a round; ``most``
    rounds without an end raise.
    """
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_b")).select("node", F.least("node", "_b").alias("label")), "labels")
    for _ in range(most):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        # labels that meet a lower one hand it on to all nodes below them
        hung = lower.groupBy(F.col("label").alias("_old")).agg(F.min("low").alias("_low"))
        step = lower.join(hung, F.col("low") == F.col("_old"), "left").select("node", F.col("label").alias("was"), F.least("low", F.coalesce("_low", "low")).alias("label"))
        step = staged(step, "labels")
        labels = step.select("node", "label")
        if step.where("label <> was").isEmpty():
            return labels
    raise ValueError(f"components are not settled after {most} rounds")
