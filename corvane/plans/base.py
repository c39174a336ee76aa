"""Registration of queries, and how the driver's tables stand for records, sessions and sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: the source is the stack, the language the domain, length bands the severity, the thirds of the text the sections, its first five tokens the tags."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    n = F.col("n_chars")
    third = F.floor((F.length("text") + 2) / 3).cast("int")
    return d.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"),
        "doc_id",
        F.col("source").alias("stack"),
        F.col("lang").alias("domain"),
        F.when(n >= 5000, "critical").when(n >= 2000, "high").when(n >= 500, "medium").otherwise("low").alias("blast_radius"),
        F.lit("community").alias("source"),
        F.substring("text", F.lit(1), third).alias("wrong"),
        F.substring("text", third + 1, third).alias("correct"),
        F.substring("text", 2 * third + 1, third).alias("symptom"),
        T.first_tokens(F.col("text"), 5).alias("tags"),
        F.when(F.col("quality") == 1, 0.9).when(F.col("quality") == 0, 0.4).alias("confidence"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("deprecated"),
        "quality",
        "toxic",
    )


# --- the same in SQL ---------------------------------------------------------


def tok(text: str, stop: list[str] = T.STOP_BASE, keep: str = "", longer_than: int = 2) -> str:
    words = ", ".join(f"'{w}'" for w in stop)
    drop = f" AND t NOT IN ({words})" if stop else ""
    return rf"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({text}, '')), '[^a-z0-9\s{keep}]', ' ', 'g'), '\s+'), lambda t: length(t) > {longer_than}{drop})"


def dtok(text: str, stop: list[str] = T.STOP_BASE) -> str:
    """Distinct tokens; the order is DuckDB's own."""
    return f"list_distinct({tok(text, stop)})"


def r(x: str, places: int = 6) -> str:
    return f"floor(({x}) * 1e{places} + 0.5) / 1e{places}"


RECORDS = f"""rec0 AS (
    SELECT d.*, quality, toxic, (length(text) + 2) // 3 AS third, {tok("text")} AS tk FROM documents d LEFT JOIN labels USING (doc_id)
), rec AS (
    SELECT 'doc_' || doc_id AS id, doc_id, source AS stack, lang AS domain,
        CASE WHEN n_chars >= 5000 THEN 'critical' WHEN n_chars >= 2000 THEN 'high' WHEN n_chars >= 500 THEN 'medium' ELSE 'low' END AS blast_radius,
        substr(text, 1, third) AS wrong, substr(text, third + 1, third) AS correct, substr(text, 2 * third + 1, third) AS symptom,
        list_filter(tk, lambda x, i: list_position(tk, x) = i)[1:5] AS tags,
        CASE quality WHEN 1 THEN 0.9 WHEN 0 THEN 0.4 END AS confidence, coalesce(toxic, 0) = 1 AS deprecated, quality, toxic
    FROM rec0
)"""
SEVERITY_RANK = "CASE blast_radius WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"
