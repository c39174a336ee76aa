"""Choosing a few candidates that differ from one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import round_to


def repulsion(overlap: Column) -> Column:
    """o / (1 - o) of an overlap within 0 and 1; equal sets repel without bound (by a million)."""
    return overlap / F.greatest(1 - overlap, F.lit(1e-6))


def jaccard(a: Column, b: Column) -> Column:
    """Of arrays of distinct items; two empty ones have nothing in common."""
    both = F.size(F.array_intersect(a, b))
    return both / F.greatest(F.lit(1), F.size(a) + F.size(b) - both)


def diverse(candidates: DataFrame, query: str, key: str, savings: str, tags: str, k: int, strength: float = 0.5, pool: int = 50) -> DataFrame:
    """(query, place, key, score): greedily the ``k`` (20 at most) of each query's ``pool`` best candidates whose savings / (1 + ``strength`` * repulsion from all chosen before) is highest.

    The repulsion is the sum of o / (1 - o) over the chosen, with o the share of tags in common. Ties go to the smaller key; scores are rounded to nine places before they
    are compared. Nulls in ``savings`` count as 0, in ``tags`` as no tags. A query's candidates are one row of at most ``pool`` entries, and the choice is a fold over them.
    """
    if not 0 < k <= 20:
        raise ValueError("k must be 1 to 20")
    s, t = F.coalesce(F.col(savings), F.lit(0.0)).cast("double"), F.array_distinct(F.coalesce(F.col(tags), F.array().cast("array<string>")))
    d = candidates.select(query, F.col(key).alias("_key"), s.alias("_s"), t.alias("_t"))
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("_s"), "_key"))).filter(F.col("_r") <= pool)
    d = d.groupBy(query).agg(F.collect_list(F.struct(F.col("_key").alias("key"), F.col("_s").alias("s"), F.col("_t").alias("t"))).alias("_all"))
    kind = candidates.schema[key].dataType.simpleString()

    def scored(c: Column, chosen: Column) -> Column:
        force = F.aggregate(chosen, F.lit(0.0), lambda total, j: total + repulsion(jaccard(c["t"], j["t"])))
        return round_to(c["s"] / (1 + strength * force), 9)

    def step(state: Column, _: Column) -> Column:
        best = F.array_min(F.transform(state["left"], lambda c: F.struct((-scored(c, state["chosen"])).alias("n"), c["key"].alias("key"), c["t"].alias("t"))))
        chosen = F.when(best.isNull(), state["chosen"]).otherwise(F.concat(state["chosen"], F.array(best)))
        return F.struct(chosen.alias("chosen"), F.filter(state["left"], lambda c: c["key"] != best["key"]).alias("left"))

    start = F.struct(F.array().cast(f"array<struct<n:double,key:{kind},t:array<string>>>").alias("chosen"), F.col("_all").alias("left"))
    picked = F.aggregate(F.sequence(F.lit(1), F.lit(k)), start, step, lambda state: state["chosen"])
    return d.select(query, F.posexplode(picked).alias("_p", "_c")).select(query, (F.col("_p") + 1).alias("place"), F.col("_c.key").alias(key), (-F.col("_c.n")).alias("score"))
