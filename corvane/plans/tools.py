"""Queries of the tools: captures, the review of grazed records, gates, chunks by SQL, and diverse choices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tools
from ..functions import text as T
from ..operators.selection import diverse
from . import corpus
from . import search as Q
from .base import RECORDS, dtok, query, r, records, table, tok

ALL = "concat_ws(' ', wrong, correct, symptom)"
#: Token sets of new (unlabelled) and own (labelled) records, and how alike they are.
NEAR = f"""{RECORDS}, own AS (SELECT * FROM rec WHERE quality IS NOT NULL), new AS (SELECT * FROM rec WHERE quality IS NULL), whole AS MATERIALIZED (SELECT id, stack, quality, {ALL} AS whole FROM rec), tk AS MATERIALIZED (SELECT id, stack, quality, {dtok('whole')} AS tk FROM whole),
    ot AS MATERIALIZED (SELECT id, stack, len(tk) AS n, unnest(tk) AS t FROM tk WHERE quality IS NOT NULL), nt AS MATERIALIZED (SELECT id, stack, len(tk) AS n, unnest(tk) AS t FROM tk WHERE quality IS NULL)"""
ALIKE = lambda on: f"al AS MATERIALIZED (SELECT a.id, b.id AS o, count(*) / (a.n + b.n - count(*)) AS j FROM nt a JOIN ot b ON a.t = b.t{on} GROUP BY a.id, b.id, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= 0.45), nr AS (SELECT id, arg_min(o, (-j, o)) AS nearest, max(j) AS similarity FROM al GROUP BY id)"


@query(f"""WITH {NEAR}, {ALIKE(" AND coalesce(a.stack, '') = coalesce(b.stack, '')")}, q AS (SELECT *, len({tok('symptom')}) < 4 AS s1, length(coalesce(wrong, '')) < 10 AS s2, length(coalesce(correct, '')) < 10 AS s3, doc_id % 2 = 0 OR len(tags) = 0 AS s4, length(coalesce(wrong, '')) + length(coalesce(correct, '')) + length(coalesce(symptom, '')) > 700 AS l1 FROM new)
    SELECT doc_id, nearest IS NULL AS captured, nearest, {r('similarity')} AS similarity, greatest(0, 10 - 2 * (s1::INT + s2::INT + s3::INT + s4::INT) - l1::INT)::INT AS quality_score FROM q LEFT JOIN nr USING (id)""")
def captured_fixes(spark: SparkSession, sf: str) -> DataFrame:
    """Unlabelled records as fixes, checked against the labelled ones of their stack."""
    rec = records(spark, sf)
    new = rec.filter("quality is null").select("doc_id", "stack", F.col("symptom").alias("error_observed"), F.col("wrong").alias("wrong_approach"), F.col("correct").alias("correct_approach"), "blast_radius", F.when(F.col("doc_id") % 2 == 1, F.col("tags")).alias("tags"), F.lit(None).cast("string").alias("title"))
    d = tools.capture_fix(rec.filter("quality is not null"), new)
    return d.select("doc_id", "captured", "nearest", T.round_to(F.col("similarity"), 6).alias("similarity"), F.col("quality_score").cast("int").alias("quality_score"))


SHORT = " OR ".join(f"length(trim({c})) < 20" for c in ("wrong", "correct", "symptom"))


@query(f"""WITH {NEAR}, {ALIKE('')}, g AS ({Q.SQL['graze_score']}), c AS (SELECT new.id, g.score, stack IS NOT NULL AND wrong IS NOT NULL AND tags IS NOT NULL AND NOT coalesce({SHORT}, false) AS ok FROM new JOIN g USING (id) WHERE g.score > 0)
    SELECT id, score, ok AS structural_ok, nearest, {r('similarity')} AS similarity, ok AND nearest IS NULL AS clean, CASE WHEN ok AND nearest IS NULL THEN 'clean' WHEN NOT ok AND nearest IS NOT NULL THEN 'both' WHEN ok THEN 'duplicate' ELSE 'structure' END AS advice FROM c LEFT JOIN nr USING (id)""")
def graze_review(spark: SparkSession, sf: str) -> DataFrame:
    """Unlabelled records as candidates of other libraries, labelled ones as the own corpus."""
    rec = records(spark, sf)
    d = tools.graze(rec.filter("quality is not null"), rec.filter("quality is null"), Q.graze_score(spark, sf))
    said = F.col("recommendation")
    advice = F.when(said.startswith("✓"), "clean").when(F.contains(said, F.lit("AND likely")), "both").when(F.contains(said, F.lit("Likely")), "duplicate").otherwise("structure")
    return d.select("id", "score", "structural_ok", "nearest", T.round_to(F.col("similarity"), 6).alias("similarity"), "clean", advice.alias("advice"))


@query(f"""WITH {RECORDS} SELECT 'mine' AS jar_name, count(*) AS seed_count, array_to_string(list_sort(list(DISTINCT stack) FILTER (stack IS NOT NULL)), ',') AS stacks, array_to_string(list_sort(list(DISTINCT domain) FILTER (domain IS NOT NULL)), ',') AS domains, (SELECT count(*) FROM ({corpus.SQL['privacy_blocking']}) WHERE blocking) AS n_violations FROM rec""")
def published_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """The manifest of all records, checked without being written."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("_text"))
    whole = records(spark, sf).join(docs, "doc_id").withColumns({"wrong": F.col("_text"), "correct": F.lit(""), "symptom": F.lit("")})  # a finding may cross sections
    d = tools.publish(whole, "mine", check=True)
    return d.select("jar_name", "seed_count", F.array_join("stacks", ",").alias("stacks"), F.array_join("domains", ",").alias("domains"), "n_violations")


@query(r"""WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(replace(coalesce(text, ''), chr(10), chr(10) || chr(10)), '\n\s*\n'), lambda x: trim(x)), lambda x: length(x) > 20) AS l FROM documents),
    s AS (SELECT doc_id, l, 0 AS k, '' AS held, NULL::VARCHAR AS done FROM p UNION ALL
        SELECT doc_id, l, k + 1, CASE WHEN held <> '' AND length(held) + length(l[k + 1]) + 2 > 1400 THEN right(held, 200) || chr(10) || chr(10) || l[k + 1] WHEN held = '' THEN l[k + 1] ELSE held || chr(10) || chr(10) || l[k + 1] END,
            CASE WHEN held <> '' AND length(held) + length(l[k + 1]) + 2 > 1400 THEN held END FROM s WHERE k < len(l)),
    c AS (SELECT doc_id, k, done AS chunk FROM s WHERE done IS NOT NULL UNION ALL SELECT doc_id, k + 1, held FROM s WHERE k = len(l) AND held <> '')
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS part, substr(sha256(chunk), 1, 16) AS hash FROM c""")
def chunk_text(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of all documents, whose lines stand for paragraphs, by the SQL table function in a lateral join."""
    tools.register_sql(spark)
    docs = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("body"))
    return spark.sql("SELECT doc_id, part, hash FROM {docs}, LATERAL chunk_text(body, 1400, 200)", docs=docs)


@query(f"""WITH RECURSIVE {RECORDS}, s AS (SELECT stack, doc_id AS id, coalesce(confidence, 0)::DOUBLE * (1 + doc_id % 7) AS v, list_distinct(tags) AS t FROM rec WHERE stack IS NOT NULL), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY stack ORDER BY v DESC, id) <= 50),
    o AS (SELECT x.stack, x.id, y.id AS other, (len(list_intersect(x.t, y.t)) / greatest(1, len(x.t) + len(y.t) - len(list_intersect(x.t, y.t))))::DOUBLE AS j FROM b x JOIN b y ON x.stack = y.stack AND x.id <> y.id), m AS (SELECT stack, id, map(list(other), list(j / greatest(1 - j, 1e-6))) AS f FROM o GROUP BY stack, id),
    c AS (SELECT b.stack, b.id, v, f FROM b LEFT JOIN m USING (stack, id)),
    p AS (SELECT stack, 0 AS place, []::BIGINT[] AS chosen, NULL::STRUCT(n DOUBLE, id BIGINT) AS best FROM (SELECT DISTINCT stack FROM b) UNION ALL
        SELECT stack, place + 1, list_append(chosen, w.id), w FROM (SELECT p.stack, p.place, any_value(p.chosen) AS chosen, min(struct_pack(n := -(floor(v / (1 + 0.5 * coalesce(list_sum(list_transform(p.chosen, lambda x: f[x])), 0)) * 1e9 + 0.5) / 1e9), id := c.id)) AS w
            FROM p JOIN c ON c.stack = p.stack AND NOT list_contains(p.chosen, c.id) WHERE p.place < 8 GROUP BY p.stack, p.place))
    SELECT stack, place::INT AS place, best.id AS doc_id, -best.n AS score FROM p WHERE place > 0""")
def diverse_records(spark: SparkSession, sf: str) -> DataFrame:
    """Of each stack's fifty best records eight that repel one another by their tags."""
    v = (F.coalesce("confidence", F.lit(0.0)) * (1 + F.col("doc_id") % 7)).cast("double")
    return diverse(records(spark, sf).filter("stack is not null").withColumn("v", v), "stack", "doc_id", "v", "tags", 8)
