"""Queries over the record corpus: index, catalogue, lint, statistics, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..operators import records as R
from ..operators import retrieval as X
from .base import RECORDS, SQL, SEVERITY_RANK, dtok, query, r, records, table, tok


@query(f"SELECT token, count(*) AS df FROM (SELECT doc_id, unnest({dtok('text')}) AS token FROM documents) GROUP BY token")
def doc_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return X.document_frequency(X.doc_tokens(table(spark, sf, "documents"), "doc_id", "text"))


@query(f"""SELECT token, {r("ln(1 + n / (1 + df))")} AS idf FROM (SELECT token, count(*) AS df FROM (SELECT doc_id, unnest({dtok('text')}) AS token FROM documents) GROUP BY token),
    (SELECT count(*)::DOUBLE AS n FROM documents)""")
def token_idf(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    return X.document_frequency(X.doc_tokens(docs, "doc_id", "text")).join(F.broadcast(n)).select("token", T.round_to(S.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query(f"""WITH {RECORDS} SELECT token, count(*) AS postings, min(doc_id) AS first_doc FROM (
    SELECT doc_id, unnest(list_distinct(list_concat({tok("symptom", T.STOP_INDEX, "_")}, list_filter(tags, lambda t: true)))) AS token FROM rec WHERE symptom <> '') GROUP BY token""")
def postings_size(spark: SparkSession, sf: str) -> DataFrame:
    d = records(spark, sf).filter("symptom <> ''")
    d = d.select("doc_id", F.explode(F.array_distinct(F.concat(T.tokens(F.col("symptom"), T.STOP_INDEX, "_"), "tags"))).alias("token"))
    return d.groupBy("token").agg(F.count(F.lit(1)).alias("postings"), F.min("doc_id").alias("first_doc"))


@query(f"""WITH {RECORDS} SELECT stack, count(*) AS seed_count, bool_or(deprecated) AS has_deprecated, bool_or(confidence IS NOT NULL) AS has_confidence,
    sum(CASE WHEN blast_radius = 'critical' THEN 1 ELSE 0 END)::BIGINT AS n_critical FROM rec GROUP BY stack""")
def stack_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).groupBy("stack").agg(
        F.count(F.lit(1)).alias("seed_count"), F.bool_or("deprecated").alias("has_deprecated"), F.bool_or(F.col("confidence").isNotNull()).alias("has_confidence"), F.count_if(F.col("blast_radius") == "critical").alias("n_critical")
    )


@query(f"""WITH {RECORDS}, t AS (SELECT stack, tag, count(*) AS n FROM (SELECT stack, unnest(tags) AS tag FROM rec) GROUP BY ALL)
    SELECT * FROM (SELECT stack, tag, n, row_number() OVER (PARTITION BY stack ORDER BY n DESC, tag)::INTEGER AS rank FROM t) WHERE rank <= 6""")
def catalog_top_tags(spark: SparkSession, sf: str) -> DataFrame:
    t = records(spark, sf).select("stack", F.explode("tags").alias("tag")).groupBy("stack", "tag").agg(F.count(F.lit(1)).alias("n"))
    return X.top(t, ["stack"], [F.desc("n"), "tag"], 6).select("stack", "tag", "n", "rank")


@query(f"""WITH {RECORDS} SELECT count(*) AS seed_count, (SELECT string_agg(stack, ',' ORDER BY stack) FROM (SELECT DISTINCT stack FROM rec)) AS stacks,
    (SELECT string_agg(domain, ',' ORDER BY domain) FROM (SELECT DISTINCT domain FROM rec)) AS domains FROM rec""")
def manifest(spark: SparkSession, sf: str) -> DataFrame:
    return R.manifest(records(spark, sf)).select("seed_count", F.array_join("stacks", ",").alias("stacks"), F.array_join("domains", ",").alias("domains"))


@query(f"""WITH {RECORDS} SELECT stack, count(*) FILTER (blast_radius = 'critical') AS critical, count(*) FILTER (blast_radius = 'high') AS high,
    count(*) FILTER (blast_radius = 'medium') AS medium, count(*) FILTER (blast_radius = 'low') AS low FROM rec GROUP BY stack""")
def severity_pivot(spark: SparkSession, sf: str) -> DataFrame:
    d = records(spark, sf).groupBy("stack").pivot("blast_radius", ["critical", "high", "medium", "low"]).agg(F.count(F.lit(1)))
    return d.select("stack", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("critical", "high", "medium", "low")])


STATS = f"""{RECORDS}, stats AS (SELECT count(*) AS total_seeds, count(DISTINCT stack) AS stacks_covered, count(*) FILTER (deprecated) AS personal_seeds,
    count(quality) AS seeds_with_doc_ref, count(quality) AS tracked_seeds, avg(confidence) AS avg_confidence, 1 AS drift_stale,
    avg(CASE WHEN length(symptom) > 0 THEN 1.0 ELSE 0.0 END) AS symptom_ratio FROM rec)"""


def _stats(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).agg(
        F.count(F.lit(1)).alias("total_seeds"), F.count_distinct("stack").alias("stacks_covered"), F.count_if("deprecated").alias("personal_seeds"), F.count("quality").alias("seeds_with_doc_ref"),
        F.count("quality").alias("tracked_seeds"), F.avg("confidence").alias("avg_confidence"), F.lit(1).alias("drift_stale"), F.avg(F.when(F.length("symptom") > 0, 1.0).otherwise(0.0)).alias("symptom_ratio"),
    )


@query(f"WITH {STATS} SELECT total_seeds, stacks_covered, personal_seeds, seeds_with_doc_ref, {r('avg_confidence')} AS avg_confidence, {r('symptom_ratio')} AS symptom_ratio FROM stats")
def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _stats(spark, sf).select("total_seeds", "stacks_covered", "personal_seeds", "seeds_with_doc_ref", T.round_to(F.col("avg_confidence"), 6).alias("avg_confidence"), T.round_to(F.col("symptom_ratio"), 6).alias("symptom_ratio"))


@query(f"""WITH {STATS}, s AS (SELECT least(100,
    CASE WHEN total_seeds >= 200 THEN 20 WHEN total_seeds >= 50 THEN 15 WHEN total_seeds >= 10 THEN 8 ELSE floor(total_seeds / 2) END
    + CASE WHEN stacks_covered >= 10 THEN 15 WHEN stacks_covered >= 5 THEN 10 ELSE floor(stacks_covered * 1.5) END
    + CASE WHEN personal_seeds >= 20 THEN 15 WHEN personal_seeds >= 5 THEN 10 ELSE personal_seeds END
    + floor(seeds_with_doc_ref / total_seeds * 20) + 5 + CASE WHEN tracked_seeds >= 10 THEN 5 ELSE 0 END + CASE WHEN avg_confidence > 0.75 THEN 5 ELSE 0 END
    + 8 + floor(symptom_ratio * 5))::BIGINT AS reputation FROM stats)
    SELECT reputation, CASE WHEN reputation >= 90 THEN 'S' WHEN reputation >= 75 THEN 'A' WHEN reputation >= 60 THEN 'B' WHEN reputation >= 40 THEN 'C' ELSE 'D' END AS grade FROM s""")
def reputation(spark: SparkSession, sf: str) -> DataFrame:
    return R.reputation(_stats(spark, sf)).select("reputation", "grade")


@query(f"""WITH {RECORDS} SELECT domain, blast_radius, count(*) AS n, grouping(domain, blast_radius)::BIGINT AS level FROM rec GROUP BY GROUPING SETS ((), (domain), (blast_radius), (domain, blast_radius))""")
def facet_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).cube("domain", "blast_radius").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("bigint").alias("level"))


@query(f"""WITH {RECORDS}, t AS (SELECT id, domain, (doc_id % 3)::INT AS tier, CASE doc_id % 5 WHEN 0 THEN 'steward-verified' WHEN 1 THEN 'disputed' END AS status, domain IN ('en', 'fr') AS registered,
    CASE domain WHEN 'en' THEN 2 WHEN 'fr' THEN 0 END AS hosts FROM rec)
    SELECT id, NOT ((tier = 2 AND coalesce(status <> 'steward-verified', true)) OR coalesce(status = 'disputed', false) OR (tier = 1 AND registered AND coalesce(hosts, 0) = 0)) AS injectable FROM t""")
def injectable(spark: SparkSession, sf: str) -> DataFrame:
    d = records(spark, sf)
    hosts = spark.createDataFrame([("en", 2), ("fr", 0)], "domain string, hosts int")
    d = d.join(F.broadcast(hosts), "domain", "left")
    status = F.when(F.col("doc_id") % 5 == 0, "steward-verified").when(F.col("doc_id") % 5 == 1, "disputed")
    return d.select("id", R.injectable((F.col("doc_id") % 3).cast("int"), status, F.col("hosts").isNotNull(), F.col("hosts")).alias("injectable"))


@query(f"WITH {RECORDS} SELECT id, stack FROM rec WHERE stack IN ('src1', 'src2') AND domain IN ('en', 'de')")
def profile_filter(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).filter(R.in_profile(F.col("stack"), F.col("domain"), ["src1", "src2"], ["en", "de"])).select("id", "stack")


@query(f"""WITH {RECORDS}, e AS (SELECT id, list_filter([CASE WHEN length(trim(wrong)) < 20 THEN 'short wrong' END, CASE WHEN length(trim(correct)) < 20 THEN 'short correct' END,
    CASE WHEN length(trim(symptom)) < 20 THEN 'short symptom' END], lambda x: x IS NOT NULL) AS errors, CASE WHEN len(tags) = 0 THEN 'no tags' ELSE '' END AS warnings FROM rec)
    SELECT id, array_to_string(errors, ';') AS errors, warnings, len(errors) = 0 AS ok FROM e""")
def structural_lint(spark: SparkSession, sf: str) -> DataFrame:
    return R.structural_lint(records(spark, sf)).select("id", F.array_join("errors", ";").alias("errors"), F.array_join("warnings", ";").alias("warnings"), "ok")


def _privacy_sql() -> str:
    parts = []
    ok = {
        "email_address": " AND NOT (split_part(lower(m), '@', 2) IN ('example.com','example.org','example.net','example.edu','test.com','yourdomain.com') OR (length(split_part(m, '@', 1)) <= 2 AND length(split_part(split_part(m, '@', 2), '.', 1)) <= 2))",
        "internal_hostname": " AND NOT (lower(m) IN ('host.docker.internal','env.local','.env.local','localhost.localdomain') OR lower(m) LIKE '%.svc.cluster.local' OR split_part(lower(m), '.', -2) IN ('env','path','test','tmp','config','settings','local','docker'))",
    }
    for rule, severity, pattern in R.PRIVACY_RULES:
        plain = pattern.replace("(?<![A-Za-z0-9_])", r"\b").replace("(?![A-Za-z0-9_])", r"\b").replace("'", "''")
        parts.append(f"SELECT doc_id, '{rule}' AS rule_id, '{severity}' AS severity, len(list_filter(regexp_extract_all(text, '{plain}'), lambda m: true{ok.get(rule, '')})) AS n_matches FROM documents")
    return " UNION ALL ".join(parts)


@query(f"SELECT doc_id, 'text' AS field, rule_id, severity, n_matches::INT AS n_matches FROM ({_privacy_sql()}) WHERE n_matches > 0")
def privacy_findings(spark: SparkSession, sf: str) -> DataFrame:
    return R.privacy_findings(table(spark, sf, "documents"), ["text"], "doc_id").drop("matches")


@query(f"""SELECT doc_id, coalesce(blocking, false) AS blocking, coalesce(findings, 0) AS findings FROM documents LEFT JOIN
    (SELECT doc_id, bool_or(severity = 'high') AS blocking, count(*) AS findings FROM ({_privacy_sql()}) WHERE n_matches > 0 GROUP BY doc_id) USING (doc_id)""")
def privacy_blocking(spark: SparkSession, sf: str) -> DataFrame:
    return R.blocking(table(spark, sf, "documents"), ["text"], "doc_id")


@query(r"""WITH h AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host FROM pages)
    SELECT page_id, host, regexp_matches(url, '^https?://') AND host <> '' AND NOT regexp_matches(host, '^(localhost|127\..*|10\..*|192\.168\..*|172\.(1[6-9]|2[0-9]|3[01])\..*|169\.254\..*|0\.0\.0\.0|::1)$') AS safe FROM h""")
def url_safety(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.url_host(F.col("url")).alias("host"), T.safe_url(F.col("url")).alias("safe"))


@query("""SELECT c_custkey AS id, n_name AS stack FROM customer JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS reviewed_at FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey
    WHERE n_nationkey % 3 <> 0 AND n_nationkey % 7 <> 0 AND (reviewed_at IS NULL OR reviewed_at < TIMESTAMP '1998-01-01')""")
def stale_review(spark: SparkSession, sf: str) -> DataFrame:
    """Customers stand for records, nations for stacks, the last order for the review."""
    reviewed = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("reviewed_at"))
    nation = table(spark, sf, "nation")
    rec = table(spark, sf, "customer").join(reviewed, F.col("c_custkey") == F.col("o_custkey"), "left").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    rec = rec.select(F.col("c_custkey").alias("id"), F.col("n_name").alias("stack"), "reviewed_at")
    stacks = nation.select(F.col("n_name").alias("stack"), (F.col("n_nationkey") % 3 != 0).alias("volatile"), F.when(F.col("n_nationkey") % 7 != 0, F.col("n_nationkey").cast("string")).alias("version"), F.lit("1998-01-01").cast("timestamp").alias("checked_at"))
    return R.stale(rec, F.broadcast(stacks)).select("id", "stack")


@query(f"SELECT token, df FROM (SELECT token, count(*) AS df FROM (SELECT doc_id, unnest({dtok('text')}) AS token FROM documents) GROUP BY token) WHERE df BETWEEN 2 AND 15")
def df_band_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return doc_frequency(spark, sf).filter(F.col("df").between(2, 15))


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def known_id_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id")


@query(f"""WITH {RECORDS} SELECT id, CASE blast_radius WHEN 'critical' THEN 'W:' || wrong || '|C:' || correct || '|S:' || symptom WHEN 'high' THEN 'C:' || substr(correct, 1, 200) || '|S:' || substr(symptom, 1, 120)
    WHEN 'medium' THEN 'S:' || substr(symptom, 1, 100) ELSE id END AS body, {SEVERITY_RANK}::INT AS ord FROM rec WHERE NOT deprecated""")
def compressed_skill(spark: SparkSession, sf: str) -> DataFrame:
    """The compression ladder of the context-budget export."""
    b = F.col("blast_radius")
    body = (
        F.when(b == "critical", F.concat(F.lit("W:"), "wrong", F.lit("|C:"), "correct", F.lit("|S:"), "symptom"))
        .when(b == "high", F.concat(F.lit("C:"), F.substring("correct", 1, 200), F.lit("|S:"), F.substring("symptom", 1, 120)))
        .when(b == "medium", F.concat(F.lit("S:"), F.substring("symptom", 1, 100)))
        .otherwise(F.col("id"))
    )
    return records(spark, sf).filter("not deprecated").select("id", body.alias("body"), S.by_severity(b, S.SEVERITY_RANK).cast("int").alias("ord"))


@query(f"""WITH {RECORDS}, one AS (SELECT id, stack, array_to_string(tags, ',') AS tags, trim(regexp_replace(symptom, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS s FROM rec)
    SELECT id, stack, tags, CASE WHEN length(s) > 80 THEN substr(s, 1, 79) || '…' ELSE s END AS symptom FROM one""")
def slim_index(spark: SparkSession, sf: str) -> DataFrame:
    """The browser index: trimmed texts, few tags."""
    return records(spark, sf).select("id", "stack", F.array_join("tags", ",").alias("tags"), T.brief(F.col("symptom"), 80).alias("symptom"))


@query(f"""WITH {RECORDS} SELECT id, substr(sha256(trim(concat_ws(' ', symptom, wrong, array_to_string(tags, ' ')))[1:2048]), 1, 16) AS hash FROM rec""")
def embedding_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Content hashes of the embedded texts, by which built vectors are reused."""
    return records(spark, sf).select("id", T.content_hash(T.embedding_text(F.col("symptom"), F.col("wrong"), F.col("tags"))).alias("hash"))


@query(f"""WITH {RECORDS}, band AS (SELECT tag FROM (SELECT tag, count(*) AS df FROM (SELECT doc_id, unnest(tags) AS tag FROM rec) GROUP BY tag) WHERE df >= 3 AND df <= 0.4 * (SELECT count(*) FROM rec)),
    pos AS (SELECT doc_id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS p FROM rec),
    first AS (SELECT doc_id, arg_min(tag, p) AS tag FROM pos JOIN band USING (tag) GROUP BY doc_id),
    named AS (SELECT rec.doc_id, stack, coalesce(tag, stack) AS c FROM rec LEFT JOIN first USING (doc_id)), sized AS (SELECT *, count(*) OVER (PARTITION BY c) AS n, first_value(stack) OVER (PARTITION BY c ORDER BY doc_id) AS home FROM named)
    SELECT CASE WHEN n < 3 THEN home ELSE c END AS cluster, count(*) AS members, min(doc_id) AS first_member FROM sized GROUP BY 1""")
def tag_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """The fallback clustering: the first tag of middling frequency, else the stack; clusters under three go to their first member's stack."""
    rec = records(spark, sf).select("doc_id", "stack", "tags")
    tags = rec.select("doc_id", F.posexplode("tags").alias("p", "tag"))
    n = rec.agg(F.count(F.lit(1)).alias("n"))
    band = tags.groupBy("tag").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(n)).filter("df >= 3 and df <= 0.4 * n").select("tag")
    first = tags.join(band, "tag").groupBy("doc_id").agg(F.min_by("tag", "p").alias("tag"))
    named = rec.join(first, "doc_id", "left").select("doc_id", "stack", F.coalesce("tag", "stack").alias("cluster"))
    sizes = named.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("doc_id", "stack")).alias("head"))
    merged = sizes.select(F.when(F.col("members") < 3, F.col("head.stack")).otherwise(F.col("cluster")).alias("cluster"), "members", F.col("head.doc_id").alias("first_member"))
    return merged.groupBy("cluster").agg(F.sum("members").alias("members"), F.min("first_member").alias("first_member"))


@query(f"""WITH {RECORDS}, q AS (SELECT id, stack, {SEVERITY_RANK} AS sev, row_number() OVER (PARTITION BY stack ORDER BY {SEVERITY_RANK}, doc_id)::INT AS rank, count(*) OVER () AS total FROM rec),
    s AS (SELECT count(DISTINCT stack) AS stacks FROM rec) SELECT id, stack, rank FROM q, s WHERE rank <= least(10, ceil(total / stacks * 1.5))""")
def stack_quota(spark: SparkSession, sf: str) -> DataFrame:
    """At most min(10, 1.5 average shares) records of each stack, the most severe first."""
    rec = records(spark, sf)
    t = rec.agg(F.least(F.lit(10), F.ceil(F.count(F.lit(1)) / F.count_distinct("stack") * 1.5)).alias("quota"))
    d = rec.withColumn("rank", F.row_number().over(Window.partitionBy("stack").orderBy(S.by_severity(F.col("blast_radius"), S.SEVERITY_RANK), "doc_id")))
    return d.join(F.broadcast(t)).filter("rank <= quota").select("id", "stack", "rank")


@query(f"""WITH {RECORDS} SELECT stack, domain, n, {r("n / sum(n) OVER (PARTITION BY stack)")} AS share FROM (SELECT stack, domain, count(*) AS n FROM rec GROUP BY ALL)""")
def source_concentration(spark: SparkSession, sf: str) -> DataFrame:
    d = records(spark, sf).groupBy("stack", "domain").agg(F.count(F.lit(1)).alias("n"))
    return d.withColumn("share", T.round_to(F.col("n") / F.sum("n").over(Window.partitionBy("stack")), 6))


@query(f"""WITH {RECORDS} SELECT id, greatest(0, 10 - 2 * ((len({tok('symptom')}) < 4)::INT + (length(wrong) < 10)::INT + (length(correct) < 10)::INT + (len(tags) = 0)::INT)
    - ((length(wrong) + length(correct) + length(symptom) > 700)::INT + (len(tags) > 8)::INT))::INT AS quality_score FROM rec""")
def capture_quality(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return records(spark, sf).select("id", S.quality(F.size(T.tokens(c("symptom"))), c("wrong"), c("correct"), c("symptom"), c("tags")).cast("int").alias("quality_score"))


@query(f"""WITH {RECORDS}, f AS (SELECT count(*) AS n FROM rec GROUP BY stack), o AS (SELECT ln(n) AS y, ln(row_number() OVER (ORDER BY n DESC)) AS x FROM f)
    SELECT {r("regr_slope(y, x)")} AS slope, count(*) AS stacks FROM o""")
def rank_frequency_slope(spark: SparkSession, sf: str) -> DataFrame:
    f = records(spark, sf).groupBy("stack").agg(F.count(F.lit(1)).alias("n"))
    o = f.select(F.log("n").alias("y"), F.log(F.row_number().over(Window.orderBy(F.desc("n")))).alias("x"))
    return o.agg(T.round_to(F.regr_slope("y", "x"), 6).alias("slope"), F.count(F.lit(1)).alias("stacks"))


@query(f"""WITH {RECORDS} SELECT id, stack, 'category_' || CASE
    WHEN regexp_matches(t, '\\b(security|xss|csrf|inject|sanitiz|escape|vuln|attack|exploit|password|token|auth(?:enticat|oriz))\\b') THEN 'security'
    WHEN regexp_matches(t, '\\b(data.?loss|corrupt|overwrite|irrecoverab|permanent.?delet|wipe)\\b') THEN 'data-loss'
    WHEN regexp_matches(t, '\\b(race.?condition|deadlock|concurren|mutex|atomic|goroutine|thread|lock|semaphore)\\b') THEN 'concurrency'
    WHEN regexp_matches(t, '\\b(performance|memory.?leak|slow|latency|timeout|cache|optim|efficienc)\\b') THEN 'performance'
    WHEN regexp_matches(t, '\\b(readab|format|naming|style|convention|maintainab)\\b') THEN 'readability' ELSE 'correctness' END AS category
    FROM (SELECT id, stack, lower('WRONG: ' || wrong || ' CORRECT: ' || correct || ' Symptom: ' || symptom || ' ' || array_to_string(tags, ' ')) AS t FROM rec)""")
def migrate_enrich(spark: SparkSession, sf: str) -> DataFrame:
    return R.enriched(records(spark, sf)).select("id", "stack", F.concat(F.lit("category_"), "antipattern_category").alias("category"))


@query(f"""WITH {RECORDS} SELECT stack, count(*) AS n_doc, sum(ceil(length(wrong || correct || symptom) / 4))::BIGINT AS token_estimate FROM rec WHERE NOT deprecated GROUP BY stack""")
def export_budget(spark: SparkSession, sf: str) -> DataFrame:
    d = records(spark, sf).filter("not deprecated")
    return d.groupBy("stack").agg(F.count(F.lit(1)).alias("n_doc"), F.sum(T.token_estimate(F.concat("wrong", "correct", "symptom"))).cast("bigint").alias("token_estimate"))


@query("""SELECT url, '<url><loc>' || replace(url, '&', '&amp;') || '</loc></url>' AS entry FROM pages""")
def sitemap_entries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("url", F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>")).alias("entry"))


@query(r"""SELECT page_id, length(t) AS n_visible, substr(sha256(t), 1, 16) AS hash FROM (SELECT page_id, trim(regexp_replace(regexp_replace(
    regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<head\b.*?</head>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) AS t FROM pages)""")
def page_chunks(spark: SparkSession, sf: str) -> DataFrame:
    bare = F.regexp_replace("html", r"(?is)<script\b.*?</script>|<style\b.*?</style>|<head\b.*?</head>", " ")
    t = F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"\s+", " "))
    return table(spark, sf, "pages").select("page_id", t.alias("t")).select("page_id", F.length("t").cast("bigint").alias("n_visible"), T.content_hash(F.col("t")).alias("hash"))
