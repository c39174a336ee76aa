"""Composed texts and views: session briefs, category files, project lists, reranked prefixes, provenance, readiness and integrity."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import text as T
from ..functions.scores import SEVERITY_RANK, by_severity

# The categories of exported files, in their order.
CATEGORIES = ("security", "data-loss", "concurrency", "performance", "correctness", "readability")
#: Severities that a brief lists, with the most records of each (None: all).
BRIEF_LIMITS = {"critical": None, "high": 4, "medium": 4}
#: Fields of a private record that a shared one lacks.
PRIVATE = ("captured_at", "project", "source", "verification_status")


def session_brief(records: DataFrame, title: str, group: str = "stack", key: str = "id", longest: int = 160, lookups: int = 12) -> DataFrame:
    """(group, part, place, line): the lines of each group's brief, the most severe records first.

    ``part`` is a severity, whose records give their title and sections cut to ``longest`` characters (medium ones their title and symptom only), or
    ``lookup``: keywords of the first ``lookups`` symptoms. Without keywords a record has no lookup line.
    """
    severity = F.coalesce("blast_radius", F.lit("medium"))
    cut = lambda c: F.substring(F.trim(F.coalesce(F.col(c), F.lit(""))), 1, longest)
    d = records.select(group, key, severity.alias("_s"), F.col(title).alias("_title"), cut("wrong").alias("_w"), cut("correct").alias("_c"), cut("symptom").alias("_y"), T.keywords(F.coalesce("symptom", F.lit(""))).alias("_k"))
    rank = by_severity(F.col("_s"), SEVERITY_RANK)
    d = d.withColumn("place", F.row_number().over(Window.partitionBy(group, "_s").orderBy(key)))
    whole = F.concat_ws(" ", F.concat(F.lit("["), "_title", F.lit("]")), *[F.when(F.col(c) != "", F.concat(F.lit(name), c)) for c, name in (("_w", "WRONG: "), ("_c", "CORRECT: "), ("_y", "Symptom: "))])
    short = F.concat(F.lit("· "), "_title", F.when(F.col("_y") != "", F.concat(F.lit(" — "), F.substring("_y", 1, 100))).otherwise(""))
    shown = F.lit(False)
    for name, most in BRIEF_LIMITS.items():
        shown = shown | ((F.col("_s") == name) & (F.lit(True) if most is None else F.col("place") <= most))
    lines = d.filter(shown).select(group, F.col("_s").alias("part"), "place", F.when(F.col("_s") == "medium", short).otherwise(whole).alias("line"))
    quick = d.filter("_y <> ''").withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(rank, key))).filter(F.col("place") <= lookups).filter("_k <> ''")
    return lines.union(quick.select(group, F.lit("lookup"), "place", F.concat(F.lit('"'), "_k", F.lit('" → '), F.col(key).cast("string"), F.lit(" ["), "_s", F.lit("]"))))


def category_files(records: DataFrame, category: Column) -> DataFrame:
    """(path, category, records, chars) of the files that records are exported to; an unknown category is ``correctness``."""
    c = F.when(category.isin(*CATEGORIES), category).otherwise("correctness")
    size = F.length(F.concat_ws("", "wrong", "correct", "symptom"))
    d = records.groupBy(c.alias("category")).agg(F.count(F.lit(1)).alias("records"), F.sum(size).cast("bigint").alias("chars"))
    return d.select(F.concat(F.lit("seeds-"), "category", F.lit(".md")).alias("path"), "category", "records", "chars")


def newest_first(projects: DataFrame, new: DataFrame, key: str = "slug") -> DataFrame:
    """(key, place): ``new`` projects replace those with their key and come before them. ``projects`` has (key, place)."""
    old = projects.join(new.select(key), key, "left_anti").withColumn("_old", F.lit(1))
    both = new.withColumn("_old", F.lit(0)).unionByName(old)
    return both.withColumn("place", F.row_number().over(Window.orderBy("_old", "place", key))).drop("_old")


def reranked(candidates: DataFrame, query: str, rank: str, judged: Column, most: int = 10) -> DataFrame:
    """``candidates`` with ``new_rank``: the first ``most`` of each query by the judge's score (0 to 10, null as 0), the rest behind them as they were."""
    score = F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.coalesce(judged, F.lit(0.0)))) / 10  # least() would pass over a null
    head = F.col(rank) <= most
    order = [F.when(head, 0).otherwise(1), F.desc(F.when(head, score)), rank]
    return candidates.withColumn("new_rank", F.row_number().over(Window.partitionBy(query).orderBy(*order)))


def latest(records: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each key, the last in ``order``."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return records.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def named_sources(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """``chunks`` with the name of their source, or its id where it has none; ``sources`` has one (source_id, name) each."""
    return chunks.join(sources.select("source_id", F.col("name").alias("_name")), "source_id", "left").withColumn("source_name", F.coalesce("_name", F.col("source_id").cast("string"))).drop("_name")


def shared_chunks(records: DataFrame) -> DataFrame:
    """Private records as they are shared: without their private fields, from the community, not yet verified."""
    return records.drop(*PRIVATE).withColumns({"source": F.lit("community"), "verification_status": F.lit("unverified")})


def grazed(records: DataFrame, chain: str, jar: Column, day: Column) -> DataFrame:
    """``records`` whose provenance ends with this jar and day; an earlier chain stays before it."""
    step = F.struct(jar.alias("jar"), day.alias("date"))
    return records.withColumn(chain, F.concat(F.coalesce(chain, F.expr("cast(array() as array<struct<jar:string,date:string>>)")), F.array(step)))


def readiness(stats: DataFrame) -> DataFrame:
    """(tier, ready) from one row with tracked, nodes and edges."""
    rules = (("distribution", F.col("tracked") >= 5), ("entropy", F.col("tracked") >= 15), ("graph", (F.col("nodes") >= 20) & (F.col("edges") >= 30)))
    return stats.select(F.explode(F.array(*[F.struct(F.lit(n).alias("tier"), c.alias("ready")) for n, c in rules])).alias("t")).select("t.*")


def integrity(records: DataFrame, postings: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """(check, failures): ids that are null or repeat, missing sections, records with a symptom that no posting names, postings and edges of unknown records."""
    ids = records.select(F.col(key).alias("_id")).distinct()
    count = lambda d, name: d.agg(F.count(F.lit(1)).alias("failures")).select(F.lit(name).alias("check"), "failures")
    empty = F.lit(False)
    for c in ("wrong", "correct", "symptom"):
        empty = empty | (F.trim(F.coalesce(c, F.lit(""))) == "")
    ends = edges.select(F.col("src").alias("_id")).union(edges.select("dst"))
    checks = [
        count(records.filter(F.col(key).isNull()), "null_id"),
        count(records.groupBy(key).count().filter("count > 1"), "repeated_id"),
        count(records.filter(empty), "missing_section"),
        count(records.filter(F.size(T.tokens(F.col("symptom"))) > 0).join(postings.select(key).distinct(), key, "left_anti"), "not_indexed"),
        count(postings.select(F.col(key).alias("_id")).distinct().join(ids, "_id", "left_anti"), "unknown_posting"),
        count(ends.distinct().join(ids, "_id", "left_anti"), "unknown_edge_end"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.union(c)
    return out


def supplemented(first: DataFrame, second: DataFrame, query: str = "query_id", doc: str = "doc_id", least: int = 2, above: float = 0.3) -> DataFrame:
    """(query, doc, score): ``first``, and rows of ``second`` that it lacks for queries of which fewer than ``least`` rows score ``above``."""
    weak = first.groupBy(query).agg(F.count_if(F.col("score") > above).alias("_n"))
    asked = second.join(weak, query, "left").filter(F.coalesce("_n", F.lit(0)) < least)
    more = asked.join(first.select(query, doc), [query, doc], "left_anti")
    return first.select(query, doc, "score").union(more.select(query, doc, "score"))


def tag_alerts(records: DataFrame, key: str, group: str = "stack", share: float = 0.4) -> DataFrame:
    """(group, tag, share): tags of more than ``share`` of a group's records."""
    n = records.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    t = records.select(group, key, F.explode(F.array_distinct("tags")).alias("tag")).groupBy(group, "tag").agg(F.count(F.lit(1)).alias("_k"))
    return t.join(n, group).filter(F.col("_k") > share * F.col("_n")).select(group, "tag", T.round_to(F.col("_k") / F.col("_n"), 6).alias("share"))


def compressed_sizes(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``rows`` with ``z_<column>``, the size of each text under deflate (null as empty). Spark has no such function, so Arrow batches go through Python."""
    fields = [pa.field(f"z_{c}", pa.int64()) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [pa.array([len(zlib.compress((t or "").encode(), 6)) for t in b.column(b.schema.get_field_index(c)).to_pylist()], pa.int64()) for c in columns]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], schema=pa.schema([*b.schema, *fields]))

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *[StructField(f"z_{c}", LongType()) for c in columns]]))


def redundant_pairs(pairs: DataFrame, below: float = 0.7) -> DataFrame:
    """(a, b, ratio) of candidate pairs (a, b, text_a, text_b) that compress together to less than ``below`` of what they take apart."""
    d = compressed_sizes(pairs.withColumn("_both", F.concat(F.coalesce("text_a", F.lit("")), F.coalesce("text_b", F.lit("")))), ["text_a", "text_b", "_both"])
    ratio = F.col("z__both") / (F.col("z_text_a") + F.col("z_text_b"))
    return d.select("a", "b", T.round_to(ratio, 6).alias("ratio")).filter(F.col("ratio") < below)
