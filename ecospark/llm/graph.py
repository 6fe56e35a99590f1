"""Connected components by alternating stars.

A round lets every node hand its larger neighbours to its smallest one, then its smaller
neighbours. Both are one aggregation, reduced within tasks, and one join that Spark can split
for a hub. The number of rounds grows with the logarithm of the longest path.

Defined cases: a link to itself and a repeated link change nothing; no links, no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import checkpointed


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node of each linked node's component. Nodes are of one ordered type."""
    x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
    links = checkpointed(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").where(F.col("v") != F.col("m")).select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = checkpointed(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(low, "u")
        small = met.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = checkpointed(small.where(F.col("u") != F.col("v")).distinct())
        # A star has one smaller neighbour per node and centres that are no one's leaf.
        moved = new.join(new.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        twice = new.groupBy("u").count().where(F.col("count") > 1).limit(1).count()
        links = new
        if not moved and not twice:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
