"""Merging new relationship edges into a store that is sharded, so that only shards that change are written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EDGE = "src string, type string, dst string, confidence double, source string, shard string"
#: Edges of old stores name their target only; once their list is touched they count as certain.
LEGACY = (1.0, "legacy")


def read_edges(spark: SparkSession, store: str) -> DataFrame:
    """The edges of a store, one folder ``shard=...`` each; a store that isn't there is empty."""
    try:
        d = spark.read.schema(EDGE).parquet(store)
        d.schema  # noqa: B018  a missing folder shows here
        return d
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], EDGE)


def merged_edges(old: DataFrame, delta: DataFrame) -> DataFrame:
    """``old`` and ``delta`` (both EDGE) as one: of edges with the same source, type and target the more confident, the old one in a tie; ``changed`` marks those that are new, raised or given a confidence.

    An old edge without a confidence is certain, and is written so, if ``delta`` has edges of its source and type; elsewhere it stays as it is.
    """
    key = ["shard", "src", "type"]
    both = old.select(*key, "dst", "confidence", "source", F.lit(1).alias("_old")).unionAll(delta.select(*key, "dst", "confidence", "source", F.lit(0)))
    own = Window.partitionBy(*key).orderBy("dst").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # the order is that of the aggregate, which so needs no shuffle of its own
    legacy = (F.min("_old").over(own) == 0) & (F.col("_old") == 1) & F.col("confidence").isNull()
    both = both.withColumn("_given", legacy).withColumns({"source": F.when(F.col("_given"), LEGACY[1]).otherwise(F.col("source")), "confidence": F.when(F.col("_given"), LEGACY[0]).otherwise(F.col("confidence"))})
    best = F.max_by(F.struct("confidence", "source"), F.struct("confidence", "_old", "source")).alias("_e")
    d = both.groupBy(*key, "dst").agg(best, F.max(F.when(F.col("_old") == 1, F.coalesce("confidence", F.lit(-1.0)))).alias("_was"), F.min("_old").alias("_new"), F.max("_given").alias("_given"))
    changed = F.col("_given") | ((F.col("_new") == 0) & (F.col("_was").isNull() | (F.col("_e.confidence") > F.col("_was"))))
    return d.select("src", "type", "dst", "_e.confidence", "_e.source", "shard", changed.alias("changed"))


def merge_edges(spark: SparkSession, store: str, delta: DataFrame, records: DataFrame | None, save: Callable[[DataFrame], DataFrame], dry_run: bool = False) -> DataFrame:
    """Merge ``delta`` (src, type, dst, confidence, source) into the store at ``store`` and return what changes: (shard, src, type, edges, changed).

    ``records`` (id, shard) tells where a source's edges belong, or, if it is None, delta's own column shard; edges of unknown sources are left out, as are loops and edges without target or confidence. Only
    shards that delta touches are read, and of these only such as hold a changed edge are written anew, each replaced as a whole, so files of all others keep
    their bytes, and a merge that is run again changes nothing. ``dry_run`` lists the changes and writes nothing.
    """
    known = delta.filter("src <> dst and type is not null and confidence is not null")
    if records is not None:
        known = known.join(records.select(F.col("id").alias("src"), "shard").filter("shard is not null").distinct(), "src")
    known = save(known.filter("shard is not null").select("src", "type", "dst", "confidence", "source", "shard"))
    merged = save(merged_edges(read_edges(spark, store).join(known.select("shard").distinct(), "shard", "left_semi"), known))
    report = merged.groupBy("shard", "src", "type").agg(F.count(F.lit(1)).alias("edges"), F.count_if("changed").alias("changed")).filter("changed > 0")
    if not dry_run:
        rewritten = merged.join(merged.filter("changed").select("shard").distinct(), "shard", "left_semi").drop("changed")
        if not rewritten.isEmpty():
            ordered = rewritten.sortWithinPartitions("shard", "src", "type", "dst")  # a shard may be most of the store, so it has a file from each task
            ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(store)
            spark.catalog.refreshByPath(store)
    return report
