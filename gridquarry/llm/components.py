"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut, forget


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the least node it can reach.

    Each round links every node's larger neighbours to its least one, then its
    smaller neighbours likewise, until nothing changes; a component ends as a
    star. Minima are combined before the shuffle and joined back on the node, so
    a hub's rows can be split among tasks. Loops and repeated edges don't matter.
    """
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = None
    while True:
        seen = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == last or not seen[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        last = seen
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # rebalanced, so that the join shuffles both of its sides and Spark can split a hub
        least = both.groupBy("u").agg(F.least(F.min("v"), "u").alias("m")).hint("rebalance")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).hint("rebalance")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = e, cut(small.unionByName(least.withColumnRenamed("m", "v")).distinct())
        forget(before)
