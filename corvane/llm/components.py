"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _linked_to_min(pairs: DataFrame) -> DataFrame:
    """``pairs(u, v)`` with ``low``: the least of u and all its v. A hub's rows meet one row per u, so large ones can be split."""
    low = pairs.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("_u"), F.least("u", "low").alias("low"))
    return pairs.join(low, F.col("u") == F.col("_u")).drop("_u")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that occurs in ``edges``; component is the smallest node reachable.

    Each round writes its edges to the shared folder; rounds grow with the logarithm of the longest chain. No part of the graph reaches the driver.
    """
    e = edges.select(F.greatest(a, b).cast("bigint").alias("u"), F.least(a, b).cast("bigint").alias("v")).filter("u <> v").distinct()
    e, seen = materialize(e, "links"), None
    while True:
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == seen:
            break
        seen = state
        both = e.union(e.select("v", "u")).toDF("u", "v")
        large = _linked_to_min(both).filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u <> v").distinct()
        down = _linked_to_min(large)
        small = down.select(F.col("v").alias("u"), F.col("low").alias("v")).union(down.select("u", "low").toDF("u", "v")).filter("u <> v").distinct()
        e = materialize(small, "links")
    roots = e.select("v").distinct().join(e.select(F.col("u").alias("_u")), F.col("v") == F.col("_u"), "left_anti")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select(F.col("v").alias("node"), F.col("v").alias("component")))
