"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """Columns node, root for every node of an edge; ``root`` is the least node of its component.

    ``edges`` has long columns u, v. A round is two groupings by node and two joins with what these give; their number
    grows with the logarithm of the component's size. The neighbours of a hub are summed up
    before they meet, and its join is one that adaptive execution splits, so no task has to hold a star.
    """
    low, high = F.least("u", "v"), F.greatest("u", "v")
    now = cut(edges.where("u <> v").select(high.alias("u"), low.alias("v")).distinct())
    seen = None

    def least(edges: DataFrame) -> DataFrame:
        """Every edge with the least neighbour m of its u."""
        return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")

    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = least(both).withColumn("m", F.least("m", "u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = least(large)
        pairs = small.select("u", "m").union(small.select(F.col("v").alias("u"), "m")).where("u <> m").distinct()
        now = cut(pairs.select("u", F.col("m").alias("v")))
    roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
