"""Spanning forests, the components and cycles that they show at every threshold, and maximal cliques, on graphs that stay distributed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import cliques as C
from .graphs import components

Save = Callable[[DataFrame], DataFrame]


def simple(edges: DataFrame) -> DataFrame:
    """(a, b, confidence) with a < b: the most confident edge between two nodes, without loops; a null confidence is 1."""
    d = edges.filter("a <> b").withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))
    return d.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("confidence").alias("confidence"))


def spanning_forest(edges: DataFrame, save: Save, rounds: int = 64) -> DataFrame:
    """(a, b, confidence) of the maximum spanning forest of ``simple`` edges; of equal confidences the edge with the smaller nodes.

    Borůvka: in a round every component takes its best edge to another one, and components that such edges join become one, so the number of components
    at least halves. A component's best edge is a minimum with map-side combine, so a component of any size is no hot key.
    """
    rest = save(edges.select("a", "b", "confidence"))
    labels = save(rest.select(F.col("a").alias("node")).unionAll(rest.select("b")).distinct().withColumn("part", F.col("node")))
    found = rest.limit(0)
    for _ in range(rounds):
        ends = rest.join(labels.select(F.col("node").alias("a"), F.col("part").alias("pa")), "a").join(labels.select(F.col("node").alias("b"), F.col("part").alias("pb")), "b")
        rest = save(ends.filter("pa <> pb").select("a", "b", "confidence", "pa", "pb"))
        edge = F.struct((-F.col("confidence")).alias("k"), "a", "b", "pa", "pb")
        best = rest.select(F.col("pa").alias("part"), edge.alias("e")).unionAll(rest.select("pb", edge)).groupBy("part").agg(F.min("e").alias("e"))
        chosen = save(best.select("e.*").distinct())
        if chosen.isEmpty():
            return found
        found = found.unionAll(chosen.select("a", "b", (-F.col("k")).alias("confidence")))
        joined = components(chosen.select(F.col("pa").alias("a"), F.col("pb").alias("b")), save)
        labels = save(labels.join(joined.select(F.col("node").alias("part"), "component"), "part").select("node", F.col("component").alias("part")))
        rest = rest.select("a", "b", "confidence")
    raise RuntimeError(f"components are still joined after {rounds} rounds")


def filtration(edges: DataFrame, forest: DataFrame, steps: int = 20, nodes: DataFrame | None = None) -> DataFrame:
    """(threshold, edges, b0, b1) at ``steps`` thresholds from 1 down to 0, two or more: kept edges, components and independent cycles.

    Kept edges that are in the maximum spanning forest join components; all others close cycles. So one count of both by threshold gives every row. An edge with a column n
    stands for so many; their nodes are those of the edges, or as many as the one row of ``nodes`` (_n) says.
    """
    step = F.ceil((1 - F.col("confidence") - 1e-12) * (steps - 1)).cast("int")  # the first threshold that keeps the edge
    counted = edges.select(step.alias("k"), (F.col("n") if "n" in edges.columns else F.lit(1)).alias("e"), F.lit(0).alias("f")).unionAll(forest.select(step, F.lit(0), F.lit(1)))
    if nodes is None:
        nodes = edges.select("a").unionAll(edges.select("b")).distinct().agg(F.count(F.lit(1)).alias("_n"))
    rows = edges.sparkSession.range(steps).select(F.col("id").cast("int").alias("k")).join(counted.groupBy(F.greatest("k", F.lit(0)).alias("k")).agg(F.sum("e").alias("e"), F.sum("f").alias("f")), "k", "left")
    upto = Window.orderBy("k")  # one row for each threshold
    total = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0))
    d = rows.select("k", total("e").alias("edges"), total("f").alias("_f")).crossJoin(F.broadcast(nodes))  # one row
    return d.select((1 - F.col("k") / (steps - 1)).alias("threshold"), "edges", (F.col("_n") - F.col("_f")).alias("b0"), (F.col("edges") - F.col("_f")).alias("b1"))


def cycle_edges(edges: DataFrame, forest: DataFrame) -> DataFrame:
    """The edges whose arrival closes a cycle, which is born at their confidence."""
    return edges.join(forest, ["a", "b"], "left_anti")


def cliques(edges: DataFrame, least: int = 3, most_edges: int = 20_000) -> DataFrame:
    """(nodes, size, confidence): maximal cliques of ``least`` nodes or more of ``simple`` edges, nodes ascending, with the mean confidence of their pairs (see ``cliques.cliques``)."""
    if least < 3:
        raise ValueError("cliques of two nodes are edges")
    one = F.lit(1).cast("bigint")
    nodes = edges.select("a").unionAll(edges.select("b")).distinct()
    return C.cliques(edges.select("a", "b", "confidence", one.alias("n_a"), one.alias("n_b")), nodes.select(F.col("a").alias("node"), F.col("a").alias("cls"), one.alias("n")), least, most_edges)
