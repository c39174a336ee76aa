"""Leader clustering: in a fixed order, an item joins the leader that it overlaps most, or leads a cluster of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlapping(sets: DataFrame, least: float = 0.6) -> DataFrame:
    """(later, earlier, shared): items of ``sets`` (item, place, ids) whose ids overlap by ``least`` of the larger set; ``place`` tells which comes first.

    Two such sets share an id among the first n - ceil(``least`` n) + 1 of each, if both are ordered alike. Rare ids come first, so that what
    is joined stays small; only pairs of fitting sizes are compared in full.
    """
    n = F.size("ids")
    d = sets.select("item", "place", "ids", n.alias("n"), F.explode("ids").alias("id"))
    often = d.groupBy("id").agg(F.count(F.lit(1)).alias("_f"))
    k = F.row_number().over(Window.partitionBy("item").orderBy("_f", "id"))
    first = d.join(often, "id").withColumn("_k", k).filter(F.col("_k") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1).select("id", "item", "place", "ids", "n")
    pairs = first.alias("x").join(first.alias("y"), "id").filter("x.place > y.place").filter(F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * least - 1e-9)
    shared = F.size(F.array_intersect("x.ids", "y.ids"))
    d = pairs.select(F.col("x.item").alias("later"), F.col("y.item").alias("earlier"), F.col("y.place").alias("place"), shared.alias("shared"), F.greatest("x.n", "y.n").alias("n")).distinct()
    return d.filter(F.col("shared") >= F.col("n") * least - 1e-9).drop("n")


def leader_clusters(sets: DataFrame, save: Callable[[DataFrame], DataFrame], least: float = 0.6) -> DataFrame:
    """(item, leader, shared) of ``sets`` (item, place, ids): as if items were taken in the order of ``place``, which tells all apart.

    An item joins the earlier leader with which it shares most ids (ties to the first), if their overlap is at least ``least`` of the larger set; otherwise it leads, and its
    ids are the cluster's. Who leads doesn't hang on one task: in every round, items without an undecided overlapping item before them
    become leaders, and those that overlap a leader before them followers, until all are decided. A round takes one step along every chain of
    overlaps, so there are as many rounds as the longest chain of items that wait for one another has, few unless the order is adverse.
    """
    sets = save(sets.select("item", "place", "ids"))
    pairs = save(overlapping(sets, least))
    open_items, open_pairs = sets.select("item"), pairs.select("later", "earlier")
    leaders = sets.select("item").limit(0)
    while not open_items.isEmpty():
        new = save(open_items.join(open_pairs.select(F.col("later").alias("item")).distinct(), "item", "left_anti"))
        gone = save(new.unionAll(open_pairs.join(new.select(F.col("item").alias("earlier")), "earlier", "left_semi").select("later")).distinct())
        leaders = leaders.unionAll(new)
        open_items = save(open_items.join(gone, "item", "left_anti"))
        for end in ("later", "earlier"):
            open_pairs = open_pairs.join(gone.select(F.col("item").alias(end)), end, "left_anti")
        open_pairs = save(open_pairs)
    leaders = save(leaders)
    best = pairs.join(leaders.select(F.col("item").alias("earlier")), "earlier", "left_semi").groupBy("later").agg(F.min_by("earlier", F.struct((-F.col("shared")).alias("n"), "place")).alias("leader"), F.max("shared").alias("shared"))
    own = sets.join(leaders, "item", "left_semi").select("item", F.col("item").alias("leader"), F.size("ids").alias("shared"))
    return own.unionByName(best.join(leaders.select(F.col("item").alias("later")), "later", "left_anti").select(F.col("later").alias("item"), "leader", "shared"))
