"""Connected components of an edge table, by alternating stars.

Each round replaces every node's edges by edges to the smallest neighbour
(first towards larger, then towards smaller nodes). The table never holds more
than about the input's edges, rounds grow with the logarithm of the longest
chain, and every round ends in a checkpoint, so lost executors recompute one
round at most. Nothing but a row count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.plans.lineage import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` long pairs -> ``node, root`` for every node that is not the
    smallest of its component (the smallest node is the root itself).
    Self loops and repeated edges are allowed; an empty table gives none."""
    e = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                    .distinct())
    seen = None
    while True:
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the minimum per node is a plain aggregate (hubs combine before the
        # shuffle); materialized, so that AQE can split a hub's join rows
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large)
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.union(low.select("u", F.col("m").alias("v"))).distinct())
