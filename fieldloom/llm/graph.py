"""Connected components of an edge table by alternating large and small stars, for tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.session import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` reaches. Nulls and loops are left out.

    Each round links every node to the smallest node around it and halves distances, so the rounds grow with the
    logarithm of the longest path. Each round's edges are checkpointed; at most two numbers a round reach the driver.
    """
    pairs = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo is not null and hi is not null and lo <> hi")
    pairs = cut(pairs.distinct())
    seen = None
    while True:
        # Large star: of each node, link the larger neighbours to the smallest of itself and its neighbours.
        both = pairs.union(pairs.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
        least = both.groupBy(F.col("lo").alias("node")).agg(F.min("hi").alias("least"))
        least = least.select("node", F.least("node", "least").alias("least"))
        large = both.join(least, both["lo"] == least["node"]).where(F.col("hi") > F.col("node")).select(F.col("least").alias("lo"), "hi")
        large = large.distinct()
        # Small star: of each node, link itself and its smaller neighbours to the smallest of them.
        least = large.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("least"))
        joined = large.join(least, large["hi"] == least["node"])
        small = joined.select(F.col("least").alias("lo"), F.explode(F.array("lo", "hi")).alias("hi")).where("lo <> hi")
        pairs = cut(small.distinct())
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    ends = pairs.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component"))
    roots = pairs.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return ends.unionByName(roots.join(ends.select("node"), "node", "left_anti"))
