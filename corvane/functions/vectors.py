"""Vector expressions over array<double>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """Of unit vectors, kept within 0 and 1; null if their lengths differ."""
    return F.when(F.size(a) == F.size(b), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - dot(a, b))))


def normalised(v: Column, least: float = 1e-9) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > least, F.transform(v, lambda x: x / norm)).otherwise(v)


def mean_vectors(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, centroid, members): the unit-length mean of each group's vectors, summed component-wise on the map side."""
    sums = df.select(group, F.posexplode(vector).alias("pos", "x")).groupBy(group, "pos").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("members"))
    whole = sums.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v"), F.max("members").alias("members"))
    return whole.select(group, normalised(F.col("v.x")).alias("centroid"), "members")


def max_sim(query: Column, doc: Column) -> Column:
    """Mean over query vectors of the best dot product with any document vector; 0 if either side is empty."""
    best = F.transform(query, lambda q: F.array_max(F.transform(doc, lambda d: dot(q, d))))
    return F.when((F.size(query) > 0) & (F.size(doc) > 0), F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(query)).otherwise(0.0)
