"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, rank_in_groups


def with_targets(sources: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """Add ``target`` to ``sources(source, source_size)``.

    Sources in code-point order, null last, weigh ``weights``, repeating. ``share`` of all sizes is
    shared by weight; a target stops at ``most`` times its source's size and the excess goes to the
    others by weight. In order of cap over weight, the first source that its level doesn't fill
    fixes the common level of all later ones, so one pass over the running sums settles all of it.
    The window has one row per source.
    """
    w = Window.orderBy(F.col("source").asc_nulls_last())
    d = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(w) - 1, F.lit(len(weights))) + 1).cast("int")))
    d = d.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    every = Window.partitionBy()
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = left / F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    d = d.withColumn("_level", level)
    settles = F.when(F.col("_level") <= F.col("cap") / F.col("weight"), F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("source").isNull().alias("last"), "source", F.col("_level").alias("level")))
    d = d.withColumn("_level", F.min(settles).over(every)["level"])
    return d.select("source", "source_size", F.coalesce(F.least("cap", F.col("weight") * F.col("_level")), F.col("cap")).alias("target"))


def subset_counts(sizes: Sequence[int], counts: Sequence[int], budget: int, window: int = 1 << 14) -> list[int]:
    """How many documents of each size to take so that the sizes add up to ``budget`` or just below.

    Every size first gives its proportional share. Single documents, large before small, bring what
    remains to at most ``window``; a bounded knapsack over the documents still free fits the rest:
    bit ``b`` of a set tells that ``b`` can be reached, counts are split into powers of two.
    """
    total = sum(s * c for s, c in zip(sizes, counts, strict=True))
    if budget >= total:
        return list(counts)
    take = [c * budget // total if s else 0 for s, c in zip(sizes, counts, strict=True)]
    rest = budget - sum(s * k for s, k in zip(sizes, take, strict=True))
    order = sorted((i for i, s in enumerate(sizes) if s), key=lambda i: -sizes[i])
    while rest > window:
        before = rest
        for i in order:
            if rest <= window:
                break
            if take[i] < counts[i] and sizes[i] <= rest:
                take[i] += 1
                rest -= sizes[i]
        if rest == before:
            break
    items = []
    for i in order:
        free, k = min(counts[i] - take[i], rest // sizes[i]), 1
        while free > 0:
            items.append((i, min(k, free)))
            free, k = free - k, 2 * k
    reach, mask, steps = 1, (1 << (rest + 1)) - 1, []
    for i, k in items:
        if reach >> rest & 1:
            break
        steps.append((reach, i, k))
        reach |= (reach << sizes[i] * k) & mask
    at = reach.bit_length() - 1
    for before, i, k in reversed(steps):
        if not before >> at & 1:
            take[i] += k
            at -= sizes[i] * k
    return take


def _plan_source(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size")
    total, target = int(pdf.source_size.iloc[0]), float(pdf.target.iloc[0])
    full = int(target // total) if total else 0
    extra = subset_counts(pdf["size"].tolist(), pdf.n.tolist(), int(target - full * total)) if total else [0] * len(pdf)
    return pdf.assign(whole=full, extra=extra)[["source", "size", "n", "source_size", "target", "whole", "extra"]]


def mix_documents(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17, keep: bool = False) -> DataFrame:
    """Take documents so that each source's words come to its target share of the mix.

    A document's size is its number of words (runs of bytes other than space and 0x09-0x0D; null: 0).
    Targets: see ``with_targets``. Of a source, every document is taken ``target // source_size`` times; the remaining
    budget is fitted on the histogram of sizes (``subset_counts``), and of each size the documents that
    come first by a seeded hash of their ids are taken once more. So no document exceeds ``most``
    times its size (``most`` is an integer or the last share is cut by it) and reruns agree.

    Only a histogram of (source, size) reaches the planner, one source at a time. Ranking within a
    size is dealt over buckets. Null sources form a source of their own, after the others; documents
    without words are taken 0 words. Repeated rows count each. Returns doc_id, source, size, source_size, target, times, taken, and
    with ``keep`` the struct ``doc`` of the row's own columns, so that ``times`` belongs to the row also where ids repeat or are null.
    """
    sized = materialize(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
            *([F.struct("*").alias("doc"), F.xxhash64("text").alias("_text")] if keep else []),
        ),
        "mix",
    )
    hist = materialize(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-hist")
    sources = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = with_targets(sources, weights, share, most).withColumnRenamed("source", "_source")
    planned = (
        hist.join(targets, F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
        .groupBy("source")
        .applyInPandas(_plan_source, "source string, size bigint, n bigint, source_size bigint, target double, whole bigint, extra bigint")
    )
    plan = materialize(planned, "mix-plan").withColumnsRenamed({"source": "_source", "size": "_size"})
    d = sized.join(plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))).drop("_source", "_size")
    d = d.withColumn("_draw", F.xxhash64(F.lit(seed), "doc_id"))
    settled = d.filter((F.col("extra") == 0) | (F.col("extra") == F.col("n"))).withColumn("times", F.col("whole") + (F.col("extra") > 0).cast("bigint"))
    drawn = rank_in_groups(d.filter((F.col("extra") > 0) & (F.col("extra") < F.col("n"))), ["source", "size"], ["_draw", "doc_id", *(["_text"] if keep else [])], "n")
    drawn = drawn.withColumn("times", F.col("whole") + (F.col("rank") < F.col("extra")).cast("bigint")).drop("rank")
    out = settled.unionByName(drawn)
    return out.select("doc_id", "source", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"), *(["doc"] if keep else []))
