"""Session logs: retrieval quality, attribution, drift, diffs, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine_distance


def session_measures(items: DataFrame, session: str, *keep: str) -> DataFrame:
    """One row per session of ``items(session, rank, cited, contradicted, clean, tracked)``.

    Untracked sessions (nothing known about citations) and sessions without a cited hit give nulls, which leave the denominators of averages.
    """
    cited = F.col("cited").cast("int")
    first = F.min(F.when(F.col("cited"), F.col("rank")))
    tracked = F.bool_or("tracked")
    return items.groupBy(session, *keep).agg(
        F.count(F.lit(1)).alias("n_injected"),
        F.when(tracked, (F.sum(cited) > 0).cast("double")).alias("hit"),
        F.when(tracked, F.avg(cited)).alias("precision"),
        (1 / first).alias("reciprocal_rank"),
        F.when(F.sum(cited) + F.sum(F.col("contradicted").cast("int")) > 0, F.sum(cited) / (F.sum(cited) + F.sum(F.col("contradicted").cast("int")))).alias("recall"),
        F.bool_or("clean").cast("double").alias("clean"),
    )


MEASURES = {"hit": "hit_rate", "precision": "precision", "reciprocal_rank": "mrr", "recall": "recall", "clean": "clean_rate", "n_injected": "avg_injected"}


def averages(round_to) -> list[Column]:
    return [round_to(F.avg(c), 6).alias(name) for c, name in MEASURES.items()]


def attribution(responses: DataFrame, records: DataFrame, key: str, response: str, least: float = 0.15, most: int = 5) -> DataFrame:
    """(response, record, recall): the share of a record's correction tokens, with repeats, that a response uses; the best few."""
    own = records.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    hits = own.join(responses, "token").groupBy(response, key, "n").agg(F.count(F.lit(1)).alias("hits"))
    d = hits.withColumn("recall", F.floor(F.col("hits") / F.col("n") * 1e6 + 0.5) / 1e6).filter(F.col("recall") >= least)
    return d.withColumn("rank", F.row_number().over(Window.partitionBy(response).orderBy(F.desc("recall"), key))).filter(F.col("rank") <= most).select(response, "rank", key, "recall")


def session_diff(recommended: DataFrame, injected: DataFrame, session: str, key: str, cap: int = 5) -> DataFrame:
    """(session, key, change): recommended and not injected, the first ``cap``; injected and no longer near the top."""
    fresh = recommended.join(injected.select(session, key), [session, key], "left_anti")
    fresh = fresh.withColumn("_n", F.row_number().over(Window.partitionBy(session).orderBy("rank"))).filter(F.col("_n") <= cap).select(session, key, F.lit("new").alias("change"))
    n = injected.groupBy(session).agg(F.count(F.lit(1)).alias("_injected"))
    near = recommended.join(n, session).filter(F.col("rank") <= 5 + F.greatest(F.col("_injected"), F.lit(5))).select(session, key)
    return fresh.union(injected.join(near, [session, key], "left_anti").select(session, key, F.lit("retired")))


def drift(turns: DataFrame, session: str, order: str, vector: str, grace: int = 3, threshold: float = 0.35) -> DataFrame:
    """Distance of each turn's vector from the session's first, and whether it drifted, after the calls of grace."""
    w = Window.partitionBy(session).orderBy(order)
    d = turns.withColumns({"call": F.row_number().over(w), "_first": F.first(vector).over(w)})
    d = d.withColumn("distance", cosine_distance(F.col("_first"), F.col(vector))).drop("_first")
    return d.withColumn("drifted", (F.col("call") > grace) & F.coalesce(F.col("distance") > threshold, F.lit(False)))


def novelty(candidates: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """(key, novelty): 1 less the mean repulsion j / (1 - j) from the chosen sets; ``chosen`` has (set, token), ``candidates`` (key, token), distinct."""
    n_sets = chosen.select("set").distinct().agg(F.count(F.lit(1)).alias("_sets"))
    a = candidates.withColumn("_na", F.count(F.lit(1)).over(Window.partitionBy(key)))
    b = chosen.withColumn("_nb", F.count(F.lit(1)).over(Window.partitionBy("set")))
    both = a.join(b, "token").groupBy(key, "set", "_na", "_nb").agg(F.count(F.lit(1)).alias("_i"))
    j = F.col("_i") / (F.col("_na") + F.col("_nb") - F.col("_i"))
    force = both.groupBy(key).agg(F.sum(j / (1 - j + 1e-9)).alias("_force"))
    d = candidates.select(key).distinct().join(force, key, "left").join(F.broadcast(n_sets))
    return d.select(key, F.greatest(F.lit(0.0), 1 - F.coalesce("_force", F.lit(0.0)) / F.greatest(F.lit(1), F.col("_sets"))).alias("novelty"))
