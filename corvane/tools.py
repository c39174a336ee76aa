"""The tools of a library of records as functions with typed arguments, over batches, and some of them as table functions for SQL.

``records`` has id, stack, blast_radius, source, wrong, correct, symptom, tags (array) and may have title, content, confidence, doc_reference.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Literal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .functions import text as T
from .operators import records as R
from .operators import retrieval as X
from .sources.scratch import saved

TEXTS = ("wrong", "correct", "symptom")
#: A capture that shares this much of its tokens with a record is likely its duplicate.
DUPLICATE = 0.45


def _content(records: DataFrame) -> Column:
    own = [F.col(c) for c in ("title", "content") if c in records.columns]
    return F.concat_ws(" ", *own, *TEXTS)


def lookup_symptom(records: DataFrame, queries: DataFrame, stack: str | None = None, limit: int = 5) -> DataFrame:
    """(query_id, rank, id, score) for ``queries`` (query_id, error_text): the best ``limit`` (1 to 20) records, of one stack if given; ties to the smaller id."""
    if not 1 <= limit <= 20:
        raise ValueError("limit must be 1 to 20")
    q = X.doc_tokens(queries, "query_id", "error_text")
    words = records.select("id", "stack", F.explode(T.distinct_tokens(_content(records))).alias("token"), F.lit(True).alias("in_text"), F.lit(False).alias("is_tag"))
    tags = records.select("id", "stack", F.explode(F.array_distinct(F.transform("tags", lambda t: F.lower(t)))), F.lit(False), F.lit(True))
    return X.lookup(q, words.unionAll(tags), records.count(), limit, doc="id", where=None if stack is None else F.col("stack") == stack)


def get_seed(records: DataFrame, stack: str, format: Literal["text", "json"] = "text") -> DataFrame:  # noqa: A002
    """(id, content) of one stack's records, as text to inject or as JSON."""
    if format not in ("text", "json"):
        raise ValueError(f"unknown format: {format}")
    d = records.filter(F.col("stack") == stack)
    title = F.coalesce(F.col("title"), F.col("id")) if "title" in records.columns else F.col("id")
    part = lambda name, c: F.concat(F.lit(name), F.coalesce(c, F.lit("")))
    text = F.concat_ws("\n", F.concat(F.lit("### "), title), part("WRONG: ", F.col("wrong")), part("CORRECT: ", F.col("correct")), part("Symptom: ", F.col("symptom")))
    return d.select("id", (text if format == "text" else F.to_json(F.struct("*"))).alias("content"))


def list_stacks(records: DataFrame, query: str | None = None, personal: DataFrame | None = None) -> DataFrame:
    """(stack, records, tags): all stacks, or those whose name or one of whose first five tags contains ``query``; personal records are the stack ``_personal``."""
    from .sources.readers import stack_listing

    d = stack_listing(records)
    if query:
        q = query.lower()
        d = d.filter(F.contains("stack", F.lit(q)) | F.exists("tags", lambda t: F.contains(t, F.lit(q))))
    if personal is None:
        return d
    own = personal.agg(F.count(F.lit(1)).alias("records")).filter("records > 0")
    return d.unionByName(own.select(F.lit("_personal").alias("stack"), "records", F.array(F.lit("personal"), F.lit("captured")).alias("tags")))


def validate_schema(records: DataFrame) -> DataFrame:
    """(id, ok, errors, warnings, blocking) of every row: its structure, and whether a privacy finding is of high severity. Rows are judged each, without a shuffle."""
    errors, warnings = R.structural_findings(records.columns)
    return R.with_blocking(records, TEXTS).select("id", (F.size(errors) == 0).alias("ok"), errors.alias("errors"), warnings.alias("warnings"), "blocking")


def publish(records: DataFrame, jar_name: str, check: bool = False, force: bool = False) -> DataFrame:
    """One row: jar_name, seed_count, stacks, domains, facets, n_violations, first_violation (the smallest id), ok, written.

    A record with a blocking privacy finding is a violation. Without ``force`` reading the row raises if there are any; with ``check`` it doesn't, and ``written`` is false.
    """
    sets = lambda c: F.array_sort(F.collect_set(c)) if c in records.columns else F.array().cast("array<string>")
    d = R.with_blocking(records, TEXTS)
    bad = F.when(F.col("blocking"), F.col("id"))
    d = d.agg(F.count(F.lit(1)).alias("seed_count"), sets("stack").alias("stacks"), sets("domain").alias("domains"), sets("facet").alias("facets"), F.count(bad).alias("n_violations"), F.min(bad).alias("_first"))
    ok = F.col("n_violations") == 0
    raised = F.raise_error(F.concat(F.lit("blocking privacy findings in "), F.col("n_violations").cast("string"), F.lit(" records, first "), F.col("_first"))).cast("boolean")
    written = F.lit(False) if check else F.lit(True) if force else F.when(ok, True).otherwise(raised)
    return d.select(F.lit(jar_name).alias("jar_name"), "seed_count", "stacks", "domains", "facets", "n_violations", F.col("_first").alias("first_violation"), ok.alias("ok"), written.alias("written"))


def capture_seed(store: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append to ``store``, rejected: id, errors) of ``seeds``: ids that are missing come from the wrong section, sources that are missing are ``personal``.

    Structure is a hard gate; privacy isn't one before publishing. An id that is in the store, or twice among the accepted, raises before anything is written.
    """
    named = seeds.withColumns({"id": T.derived_id(F.col("id"), F.col("wrong")), "source": F.coalesce(F.col("source"), F.lit("personal"))})
    d = R.structural_lint(named)
    return R.staged(store, d.filter("ok").drop("errors", "warnings", "ok")), d.filter("not ok").select("id", "errors")


def nearest_known(new: DataFrame, known: DataFrame, least: float = DUPLICATE, block: str | None = "stack", key: str = "id") -> DataFrame:
    """(key, nearest, similarity): for rows of ``new`` the record of ``known`` (of another id and the same ``block``) with the most similar tokens, at ``least`` or more; ties to the smaller id.

    ``key`` tells the rows of ``new`` apart. Equal token sets of a side are joined as one, so copies on both sides don't square up, and of the pairs found
    a task of the comparison gives at most two for a set of ``new``.
    """
    cols = [block] if block else []
    tokens = F.array_sort(F.transform(T.distinct_tokens(F.concat_ws(" ", *TEXTS)), lambda t: F.xxhash64(t)))
    side = lambda d, s, k: d.select(k, *(["id"] if k != "id" else []), *[F.coalesce(c, F.lit("")).alias(c) for c in cols], F.lit(s).alias("_side"), tokens.alias("_t")).withColumn("_k", F.concat_ws("/", "_side", F.sha2(F.array_join(F.col("_t").cast("array<string>"), " "), 256), *cols))
    rows = side(new, "new", key).unionByName(side(known, "known", "id"), allowMissingColumns=True)
    rows = saved(rows.withColumns({"_n": F.size("_t"), "_row": F.monotonically_increasing_id()}))  # tokens once; all but the step that deals sets out reads the narrow columns only
    # the two smallest ids of a class of known records, so that a record isn't its own duplicate
    old = rows.filter("_side = 'known'").select("_k", "id")
    first = old.groupBy("_k").agg(F.min("id").alias("_1"))
    second = old.join(first, "_k").filter("id <> _1").groupBy("_k").agg(F.min("id").alias("_2"))
    one = rows.groupBy("_k").agg(F.min("_row").alias("_row")).join(first, "_k", "left").join(second, "_k", "left").drop("_k")
    sets = rows.join(one, "_row").select("_k", "_side", *cols, F.col("_t").alias("tokens"), "_n", "_1", "_2")
    pairs = X.similar_pairs(sets, "_k", least, block, "_side", carry=("_1", "_2"), nearest=("_1", "_2"), size="_n", postings=1_000_000)
    pairs = pairs.select(F.when(F.col("a").startswith("new/"), F.col("a")).otherwise(F.col("b")).alias("_k"), *[F.coalesce(f"{c}_a", f"{c}_b").alias(c) for c in ("_1", "_2")], "similarity")
    found = rows.filter("_side = 'new'").select(*dict.fromkeys([key, "id"]), "_k").join(pairs, "_k")
    found = found.withColumn("nearest", F.when(F.col("_1") != F.col("id"), F.col("_1")).otherwise(F.col("_2"))).filter("nearest is not null")
    best = F.min_by(F.struct("nearest", "similarity"), F.struct(-F.col("similarity"), F.col("nearest")))
    return found.groupBy(key).agg(best.alias("_b")).select(key, "_b.nearest", "_b.similarity")


def capture_fix(records: DataFrame, fixes: DataFrame, force: bool = False) -> DataFrame:
    """Of every fix (stack, error_observed, wrong_approach, correct_approach, blast_radius, tags, title): the record to keep and what to tell of it.

    Adds id, title, wrong, correct, symptom, content, source, verification_status, and captured (false if a record of its stack is likely the same, unless ``force``), nearest,
    similarity, quality_score (10 less two for each field that is too short or missing, one for each that is too long) and upload_blocked (a high privacy finding). Fixes
    of one id are rows each.
    """
    title = F.coalesce("title", F.concat(F.coalesce("stack", F.lit("unknown")), F.lit(": "), F.substring("error_observed", 1, 40)))
    d = fixes.withColumns({"title": title, "blast_radius": F.coalesce("blast_radius", F.lit("medium")), "_tags": F.col("tags")})
    d = d.withColumnsRenamed({"wrong_approach": "wrong", "correct_approach": "correct", "error_observed": "symptom"})
    d = d.withColumns({"id": T.capture_slug(F.col("title")), "tags": F.coalesce("tags", F.slice(T.tokens(F.col("symptom")), 1, 4)), "source": F.lit("personal"), "verification_status": F.lit("unverified")})
    d = d.withColumn("content", F.concat(F.lit("WRONG: "), "wrong", F.lit(" CORRECT: "), "correct", F.lit(" Symptom: "), "symptom"))
    length = lambda c: F.length(F.coalesce(c, F.lit("")))
    n = F.coalesce(F.size("_tags"), F.lit(0))
    short = [F.size(T.tokens(F.col("symptom"))) < 4, length("wrong") < 10, length("correct") < 10, n <= 0]
    long = [length("wrong") + length("correct") + length("symptom") > 700, n > 8]
    ones = lambda tests: sum((t.cast("int") for t in tests), F.lit(0))
    d = d.withColumn("quality_score", F.greatest(F.lit(0), 10 - 2 * ones(short) - ones(long))).drop("_tags")
    d = R.with_blocking(d, [*TEXTS, "title"]).withColumnRenamed("blocking", "upload_blocked")
    d = d.withColumn("_key", F.sha2(F.to_json(F.struct("id", "stack", *TEXTS)), 256))
    near = nearest_known(d.select("_key", "id", "stack", *TEXTS).dropDuplicates(["_key"]), records, key="_key")
    d = d.join(near, "_key", "left").drop("_key")
    return d.withColumn("captured", F.lit(True) if force else F.col("nearest").isNull())


def graze(own: DataFrame, candidates: DataFrame, score: DataFrame, duplicate: float = DUPLICATE) -> DataFrame:
    """(id, score, structural_ok, errors, nearest, similarity, clean, recommendation): the review queue of ``candidates`` whose relevance ``score`` (id, score) is above 0 and whose id isn't known.

    Nothing is merged: it is what a person decides by. Likely duplicates are looked for in all of ``own``.
    """
    errors, _ = R.structural_findings(candidates.columns)
    d = candidates.select("id", errors.alias("errors")).withColumn("structural_ok", F.size("errors") == 0)  # before the joins, which then move no text
    d = d.join(own.select("id"), "id", "left_anti").join(score.filter("score > 0"), "id").select("id", "score", "errors", "structural_ok")
    d = d.join(nearest_known(candidates, own, duplicate, None), "id", "left")
    twin = F.col("nearest").isNotNull()
    overlap = F.concat(F.lit('"'), "nearest", F.lit('" ('), F.floor(F.col("similarity") * 100 + 0.5).cast("string"), F.lit("% overlap)"))
    advice = (
        F.when(F.col("structural_ok") & ~twin, "✓ Clean — safe to review for grafting")
        .when(~F.col("structural_ok") & twin, F.concat(F.lit("⚠ Structural issues AND likely duplicate of "), overlap, F.lit(" — fix or discard")))
        .when(twin, F.concat(F.lit("⚠ Likely duplicate of "), overlap, F.lit(" — consider refining that seed instead")))
        .otherwise("⚠ Structural issues — fix before grafting")
    )
    return d.select("id", "score", "structural_ok", "errors", "nearest", "similarity", (F.col("structural_ok") & ~twin).alias("clean"), advice.alias("recommendation"))


@udtf(returnType="part int, heading string, chunk string, hash string")
class ChunkText:
    """``chunk_text(text, most, overlap)``: sections at headings, paragraphs packed to ``most`` characters with a carry of ``overlap``; a null text has none."""

    def eval(self, text: str, most: int = 1400, overlap: int = 200) -> Iterator[tuple]:
        import hashlib
        import re

        part = 0
        for body in re.split(r"(?m)^(?=#{1,3}\s)", text or ""):
            head = re.match(r"#{1,3}\s+([^\n]{1,119})", body)
            held = ""
            paragraphs = [p.strip(" ") for p in re.split(r"\n\s*\n", re.sub(r"^#{1,3}\s+[^\n]*\n?", "", body))]
            for p in [*(p for p in paragraphs if len(p) > 20), None]:
                if held and (p is None or len(held) + len(p) + 2 > most):
                    yield part, head.group(1) if head else "", held, hashlib.sha256(held.encode()).hexdigest()[:16]
                    part, held = part + 1, held[-overlap:] if overlap else ""
                held = p if not held else f"{held}\n\n{p}" if p is not None else held


@udtf
class Fields:
    """``json_fields(document, 'a', 'b.c', ...)``: one row with a column for each path that the call names, null where the document has none; polymorphic, as the columns come from the arguments."""

    @staticmethod
    def analyze(document: AnalyzeArgument, *paths: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(document.dataType, StringType):
            raise ValueError("json_fields reads a string")
        if not paths or any(not p.isConstantExpression or not isinstance(p.value, str) for p in paths):
            raise ValueError("json_fields takes constant paths")
        schema = StructType()
        for p in paths:
            schema = schema.add(p.value.replace(".", "_"), StringType())
        return AnalyzeResult(schema)

    def eval(self, document: str, *paths: str) -> Iterator[tuple]:
        import json

        try:
            found = json.loads(document or "null")
        except ValueError:
            found = None
        row = []
        for path in paths:
            at = found
            for step in path.split("."):
                at = at.get(step) if isinstance(at, dict) else None
            row.append(at if at is None or isinstance(at, str) else json.dumps(at))
        yield tuple(row)


def register_sql(spark: SparkSession, records: str | None = None) -> None:
    """Make ``chunk_text`` and ``json_fields`` callable from SQL, and with the name of a table or view of records ``get_seed(stack)`` and ``list_stacks(word)`` too, which are plain SQL."""
    spark.udtf.register("chunk_text", ChunkText)
    spark.udtf.register("json_fields", Fields)
    if records:
        spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION get_seed(wanted STRING) RETURNS TABLE (id STRING, content STRING)
            RETURN SELECT id, concat('WRONG: ', coalesce(wrong, ''), '\\nCORRECT: ', coalesce(correct, ''), '\\nSymptom: ', coalesce(symptom, '')) FROM {records} WHERE stack = wanted""")
        spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION list_stacks(word STRING DEFAULT '') RETURNS TABLE (stack STRING, records BIGINT)
            RETURN SELECT stack, count(*) FROM {records} WHERE contains(stack, lower(word)) GROUP BY stack""")
