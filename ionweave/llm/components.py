"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir, written


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, label) for each node of the links (a, b), both long; the label is its component's smallest node.

    Each round hangs the larger neighbours of a node, then the smaller ones, on
    the smallest; stars with many points are joined, not gathered.  A link from
    a node to itself names the node alone; null ends are left out.
    """
    folder = shared_dir(links.sparkSession, "components")
    links = links.where("a is not null and b is not null")
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{folder}/0")
    state = None
    for k in range(1, most):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.unionByName(edges.where("a = b")).distinct(), f"{folder}/{k}l")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        edges = written(small.distinct(), f"{folder}/{k}s")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("the components did not settle")
    return edges.unionByName(edges.select(F.col("b").alias("a"), "b")).groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node")
