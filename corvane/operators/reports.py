"""Reports over the corpus: achievements, review queues, submissions, batch validation, migration and saturation checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import records as R

# Fixed values: (achievement, condition on the one row of corpus statistics).
ACHIEVEMENTS = (
    ("first_stone", "total_seeds >= 10"),
    ("chiseled", "total_seeds >= 50"),
    ("geologist", "total_seeds >= 200"),
    ("polymath", "stacks_covered >= 5"),
    ("seed_author", "personal_seeds > 0"),
    ("battle_tested", "personal_seeds >= 10"),
    ("well_sourced", "total_seeds > 0 and seeds_with_doc_ref / total_seeds >= 0.5"),
    ("fully_documented", "total_seeds > 0 and seeds_with_doc_ref / total_seeds >= 0.9"),
    ("precise", "symptom_ratio >= 0.95"),
    ("validated", "tracked_seeds > 0"),
    ("high_confidence", "tracked_seeds >= 10 and avg_confidence > 0.75"),
    ("drift_free", "drift_stale is not null and drift_stale = 0"),
    ("provenance_rich", "grafted_ratio > 0 or personal_seeds > 5"),
    ("universal_contributor", "has_universal_stack"),
)
ENRICHMENT = R.ENRICHMENT


def achievements(stats: DataFrame) -> DataFrame:
    """(achievement, reached) from the one row of ``stats``."""
    rows = F.array(*[F.struct(F.lit(name).alias("achievement"), F.coalesce(F.expr(rule), F.lit(False)).alias("reached")) for name, rule in ACHIEVEMENTS])
    return stats.select(F.explode(rows).alias("a")).select("a.*")


def needs_migration(columns: list[str]) -> Column:
    """Whether any enrichment field is missing, null or empty; a column that isn't there counts as missing."""
    missing = [F.coalesce(F.col(c).cast("string"), F.lit("")) == "" if c in columns else F.lit(True) for c in ENRICHMENT]
    test = missing[0]
    for m in missing[1:]:
        test = test | m
    return test


def validated(records: DataFrame, fields: list[str], key: str) -> DataFrame:
    """(key, ok, all_ok): structurally sound and without blocking privacy findings, row by row; ``all_ok`` tells whether every record of the batch is."""
    d = R.structural_lint(R.with_blocking(records, fields)).select(key, (F.col("ok") & ~F.col("blocking")).alias("ok"))
    return d.join(F.broadcast(d.agg(F.bool_and("ok").alias("all_ok"))))


def publishable(records: DataFrame, fields: list[str], key: str, override: bool = False) -> DataFrame:
    """``records``; reading one with a blocking finding raises, unless ``override``."""
    if override:
        return records
    d = R.with_blocking(records, fields)
    return d.filter(F.when(F.col("blocking"), F.raise_error(F.concat(F.lit("blocking privacy finding: "), F.coalesce(F.col(key).cast("string"), F.lit("no id")))).isNull()).otherwise(True)).drop("blocking")


def stacks_matching(records: DataFrame, word: str) -> DataFrame:
    """(stack, records): stacks whose name, or one of whose first five tags in order of their records, contains ``word``."""
    w = Window.partitionBy("stack").orderBy("_at", "_p", "_tag")
    t = records.select("stack", F.col("doc_id").alias("_r"), F.posexplode("tags").alias("_p", "_tag")).groupBy("stack", "_tag").agg(F.min(F.struct("_r", "_p")).alias("_at0"))
    t = t.select("stack", "_tag", F.col("_at0._r").alias("_at"), F.col("_at0._p").alias("_p")).withColumn("_k", F.row_number().over(w)).filter("_k <= 5").groupBy("stack").agg(F.bool_or(F.contains("_tag", F.lit(word))).alias("_hit"))
    n = records.groupBy("stack").agg(F.count(F.lit(1)).alias("records"))
    return n.join(t, "stack", "left").filter(F.contains(F.lower("stack"), F.lit(word)) | F.coalesce("_hit", F.lit(False))).select("stack", "records")


def saturated(pairs: DataFrame, least: int = 5) -> DataFrame:
    """(stack, members): stacks with more than ``least`` records that are near another; ``pairs`` has (stack, a, b)."""
    m = pairs.select("stack", F.col("a").alias("m")).union(pairs.select("stack", "b")).groupBy("stack").agg(F.count_distinct("m").alias("members"))
    return m.filter(F.col("members") > least)
