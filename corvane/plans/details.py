"""Queries of text expressions, gates and reports that work record by record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..operators import exports as E
from ..operators import graphs as G
from ..operators import records as R
from ..operators import relations as L
from ..operators import reports as P
from ..operators import twins
from ..sources.scratch import saved
from . import relations as R_
from .base import RECORDS, SEVERITY_RANK, query, r, records, table, tok

LISTS = {"multi": T.STOP_MULTI, "relations": T.STOP_RELATIONS, "cluster": T.STOP_CLUSTER, "compact": T.STOP_COMPACT, "project": T.STOP_PROJECT}


@query("SELECT doc_id, " + ", ".join(f"md5(array_to_string({tok('text', words)}, ' ')) AS {name}" for name, words in LISTS.items()) + " FROM documents")
def tokenizer_variants(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", *[F.md5(F.array_join(T.tokens(F.col("text"), words), " ").cast("binary")).alias(name) for name, words in LISTS.items()])


STAB = tok("text", [])
KEYS = tok("text", T.STOP_KEYWORDS, longer_than=3)


@query(f"""WITH l AS (SELECT doc_id, text, {STAB} AS l, {KEYS} AS k FROM documents) SELECT doc_id, md5(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ')) AS stability, array_to_string(k[1:3], ' · ') AS keywords,
    {r("(contains(lower(text), 'the')::INT + contains(lower(text), 'error')::INT + contains(lower(text), 'ed')::INT) / 3.0", 3)} AS intent FROM l""")
def text_views(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.md5(F.array_join(T.stability_tokens(c), " ").cast("binary")).alias("stability"), T.keywords(c).alias("keywords"), T.intent_share(c, "the Error ed").alias("intent"))


INTENTS = {"en": ("the and", "ed al"), "de": ("der und", "en"), "fr": ("le et", "de la")}


@query("WITH i AS (SELECT * FROM (VALUES " + ", ".join(f"('{lang}', {w!r})" for lang, pool in INTENTS.items() for w in pool) + f""") t(lang, intent)), w AS (SELECT lang, intent, unnest(string_split(intent, ' ')) AS w FROM i),
    s AS (SELECT doc_id, intent, {r("avg(contains(lower(text), w)::INT)", 3)} AS s FROM documents JOIN w USING (lang) GROUP BY ALL) SELECT doc_id, max(s) AS score FROM s GROUP BY doc_id""")
def intent_score(spark: SparkSession, sf: str) -> DataFrame:
    """The best share of any intent of the record's domain."""
    c, best = F.col("text"), None
    for lang, pool in INTENTS.items():
        best = F.when(F.col("lang") == lang, F.greatest(*[T.intent_share(c, w) for w in pool])) if best is None else best.when(F.col("lang") == lang, F.greatest(*[T.intent_share(c, w) for w in pool]))
    return table(spark, sf, "documents").filter(F.col("lang").isin(*INTENTS)).select("doc_id", best.alias("score"))


ONE = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"


def _content() -> F.Column:
    one = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.concat(F.lit("WRONG: "), one(F.col("wrong")), F.lit(" CORRECT: "), one(F.col("correct")), F.lit(" Symptom: "), one(F.col("symptom")))


CONTENT = f"'WRONG: ' || {ONE('wrong')} || ' CORRECT: ' || {ONE('correct')} || ' Symptom: ' || {ONE('symptom')}"


@query(f"""WITH {RECORDS}, c AS (SELECT id, {ONE('wrong')} AS w, {ONE('correct')} AS c, {ONE('symptom')} AS s, {CONTENT} AS t FROM rec) SELECT id, nullif(regexp_extract(t, '(?i)Symptom:\\s*(.+?)(?:\\.\\s|$)', 1), '') AS first_sentence, w AS wrong, c[1:200] AS correct, s AS symptom FROM c""")
def sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections read back from the composed content."""
    d = records(spark, sf).select("id", _content().alias("t"))
    t = F.col("t")
    return d.select("id", T.first_sentence_of_symptom(t).alias("first_sentence"), T.section(t, "WRONG").alias("wrong"), T.section(t, "CORRECT", most=200).alias("correct"), T.symptom_or_content(F.lit(None).cast("string"), t).alias("symptom"))


SNAKE = lambda c: f"substr(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 80)"


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, 'untitled') AS t FROM documents) SELECT doc_id, {SNAKE('t')} AS snake, md5(regexp_replace(regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS kebab,
    array_to_string(list_filter(string_split({SNAKE('t')}, '_'), lambda x: x <> '')[1:8], '_') AS derived, substr(regexp_replace(trim(regexp_replace(lower(t), '[^a-z0-9 ]', '', 'g')), ' +', '_', 'g'), 1, 60) AS capture FROM d""")
def slugs(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("untitled")).alias("t"))
    t = F.col("t")
    return d.select("doc_id", T.snake_slug(t).alias("snake"), F.md5(T.kebab_slug(t).cast("binary")).alias("kebab"), T.derived_id(F.lit(None).cast("string"), t).alias("derived"), T.capture_slug(t).alias("capture"))


@query(r"""SELECT page_id, regexp_matches(url, '/docs/?$|/guide/?$|/reference/?$|/manual/?$|/getting-started/?$|/introduction/?$|/overview/?$|wikipedia\.org/wiki/Mathematics$') AS generic, regexp_matches(url, '^https://') AND page_id % 10 >= 7 AND page_id % 3 > 0 AS accepted,
    'https://example.org/new?title=' || replace(replace(replace(replace(replace(replace(replace(url, '%', '%25'), ':', '%3A'), '/', '%2F'), '?', '%3F'), '=', '%3D'), '&', '%26'), '#', '%23') AS submission FROM pages""")
def url_views(spark: SparkSession, sf: str) -> DataFrame:
    """Generic pages, accepted citations, and pre-filled submission links."""
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", T.generic_url(url).alias("generic"), T.accepted_citation(F.col("page_id") % 10 / 10, F.col("page_id") % 3 > 0, url).alias("accepted"), F.concat(F.lit("https://example.org/new?title="), F.url_encode(url)).alias("submission"))


@query("""SELECT p_partkey, split_part(v, '.', 1) AS major, split_part(v, '.', 1) || '.' || split_part(v, '.', 2) AS minor, coalesce(TRY_CAST(split_part(v, '.', 1) AS INT) IN (4, 3), false) AS compatible, 'jar_' || p_size || ' (' || v || ') → ' || 'local (1.0)' AS provenance
    FROM (SELECT *, (p_size % 7) || '.' || (p_partkey % 10) || '.1' AS v FROM part)""")
def version_views(spark: SparkSession, sf: str) -> DataFrame:
    v = F.concat_ws(".", (F.col("p_size") % 7).cast("string"), (F.col("p_partkey") % 10).cast("string"), F.lit("1"))
    d = table(spark, sf, "part").withColumn("v", v)
    chain = F.array(F.struct(F.concat(F.lit("jar_"), F.col("p_size").cast("string")).alias("jar"), F.col("v").alias("date")), F.struct(F.lit("local").alias("jar"), F.lit("1.0").alias("date")))
    return d.select("p_partkey", T.version_tracked(F.col("v"), False).alias("major"), T.version_tracked(F.col("v"), True).alias("minor"), T.compatible_version(T.version_tracked(F.col("v"), False), 4).alias("compatible"), T.provenance_chain(chain).alias("provenance"))


HEADS = ("Bug history", "Session rules", "Common mistakes", "Design patterns", "Gotchas", "Warnings", "System overview", "Code map", "Method", "Zebra")


@query(f"""SELECT p_partkey, CASE WHEN regexp_matches(t, 'bug|common mistake|avoid|pitfall|error') THEN 'bugs' WHEN regexp_matches(t, 'rule|session|best practice|guideline|principle') THEN 'rules' WHEN regexp_matches(t, 'pattern|technique|method') THEN 'patterns'
    WHEN regexp_matches(t, 'gotcha|warning|caution|note') THEN 'gotchas' WHEN regexp_matches(t, 'architecture|map|structure|overview') THEN 'architecture' END AS section FROM (SELECT p_partkey, lower((['{"', '".join(HEADS)}'])[p_partkey % 10 + 1]) AS t FROM part)""".replace('"', "'").replace("''", "'"))
def heading_classes(spark: SparkSession, sf: str) -> DataFrame:
    head = F.element_at(F.array(*[F.lit(h) for h in HEADS]), (F.col("p_partkey") % 10 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", T.heading_class(head).alias("section"))


SUM = f"CASE WHEN s <> '' THEN title || ': ' || substr(string_split(s, '.')[1], 1, 100) ELSE substr(title, 1, 120) END"


@query(f"""WITH {RECORDS}, x AS (SELECT id, stack, domain, {ONE('symptom')} AS s, 'Title ' || id AS title FROM rec) SELECT id, {SUM} AS summary, substr(s, 1, 150) AS trigger, CASE WHEN stack NOT IN ('src1', 'universal') THEN stack END AS applies_stack,
    CASE WHEN domain NOT IN ('en', 'meta') THEN domain END AS applies_domain, CASE WHEN domain IN ('de', 'fr') THEN domain ELSE 'correctness' END AS category FROM x""")
def enrichment_fields(spark: SparkSession, sf: str) -> DataFrame:
    d = records(spark, sf).select("id", "stack", "domain", F.trim(F.regexp_replace(F.coalesce("symptom", F.lit("")), r"\s+", " ")).alias("s"), F.concat(F.lit("Title "), "id").alias("title"))
    applies = lambda c, none: F.when(~F.col(c).isin(*none), F.col(c))
    return d.select("id", T.mechanical_summary(F.col("title"), F.col("s")).alias("summary"), F.substring("s", 1, 150).alias("trigger"), applies("stack", ["src1", "universal"]).alias("applies_stack"), applies("domain", ["en", "meta"]).alias("applies_domain"), F.when(F.col("domain").isin("de", "fr"), F.col("domain")).otherwise("correctness").alias("category"))


@query(f"""WITH {RECORDS} SELECT id, stack, array_to_string(tags[1:8], ',') AS tags, CASE WHEN length({ONE('symptom')}) > 280 THEN substr({ONE('symptom')}, 1, 279) || '…' ELSE {ONE('symptom')} END AS symptom FROM rec
    WHERE length(trim(wrong)) >= 20 AND length(trim(correct)) >= 20 AND length(trim(symptom)) >= 20""")
def browser_index(spark: SparkSession, sf: str) -> DataFrame:
    """Lint-clean records only, texts trimmed to 280 characters, at most eight tags."""
    return R.structural_lint(records(spark, sf)).filter("ok").select("id", "stack", F.array_join(F.slice("tags", 1, 8), ",").alias("tags"), T.brief(F.col("symptom"), 280).alias("symptom"))


@query(f"""WITH {RECORDS} SELECT id, 'Title ' || id AS title, substr(symptom, 1, 200) AS symptom, array_to_string(tags, ' ') AS tags, coalesce(blast_radius, 'medium') AS blast_radius FROM rec WHERE NOT deprecated""")
def meta_index(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).filter("not deprecated").select("id", F.concat(F.lit("Title "), "id").alias("title"), F.substring("symptom", 1, 200).alias("symptom"), F.array_join("tags", " ").alias("tags"), F.coalesce("blast_radius", F.lit("medium")).alias("blast_radius"))


@query(f"""WITH {RECORDS} SELECT stack, md5(concat_ws(' | ', id, 'WRONG: ' || wrong, 'CORRECT: ' || correct, 'Symptom: ' || symptom)) AS line FROM rec WHERE NOT coalesce(deprecated, false)""")
def stack_text_lines(spark: SparkSession, sf: str) -> DataFrame:
    return E.stack_texts(records(spark, sf)).select("stack", F.md5(F.col("value").cast("binary")).alias("line"))


@query(f"""WITH {RECORDS}, x AS (SELECT stack || '/' || replace(id, '_', '-') AS path, regexp_replace(id, '_', '-') AS slug FROM rec) SELECT path || '.md' AS path FROM x""")
def page_paths(spark: SparkSession, sf: str) -> DataFrame:
    return E.pages(records(spark, sf)).select("path")


@query("""SELECT doc_id, md5(regexp_replace(replace(coalesce(text, ''), 'ed ', 'ing '), '\\bthe\\b', 'THE', 'g')) AS text FROM documents""")
def rewritten_texts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return E.rewritten(d, "text", {"ed ": "ing "}, {"the": "THE"}).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), x AS (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1)::INT AS line FROM l) SELECT doc_id, line FROM x WHERE regexp_matches(text, '[0-9]{4}')""")
def line_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    return E.occurrences(table(spark, sf, "documents"), "doc_id", "text", "[0-9]{4}").select("doc_id", "line")


@query("""SELECT doc_id, quality FROM labels WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 7 AS quality FROM labels WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id + 100000000, 7 FROM labels WHERE doc_id % 6 = 0""")
def upserted_labels(spark: SparkSession, sf: str) -> DataFrame:
    """New rows replace those with the same key."""
    old = table(spark, sf, "labels").select("doc_id", "quality")
    third = lambda n, add: old.filter(F.col("doc_id") % n == 0).select((F.col("doc_id") + add).alias("doc_id"), F.lit(7).cast(old.schema["quality"].dataType).alias("quality"))
    return R.upserted(old, third(3, 0).union(third(6, 100000000)), "doc_id")


@query(f"""WITH {RECORDS}, c AS (SELECT id, stack, sha256(coalesce(wrong, '')) AS hash FROM rec), b AS (SELECT id, stack, CASE WHEN ascii(right(id, 1)) % 2 = 0 THEN hash ELSE 'old' END AS hash FROM c) SELECT id, CASE WHEN ascii(right(id, 1)) % 2 = 0 THEN 'reuse' ELSE 'build' END AS what FROM b""")
def reuse_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Built rows whose id, hash and model still hold, and the rows to build."""
    cur = records(spark, sf).select("id", F.sha2(F.coalesce("wrong", F.lit("")), 256).alias("hash"), F.lit("m1").alias("model_id"))
    built = cur.withColumn("hash", F.when(F.ascii(F.right("id", F.lit(1))) % 2 == 0, F.col("hash")).otherwise("old"))
    keep, todo = R.reusable(cur, built)
    return keep.select("id", F.lit("reuse").alias("what")).union(todo.select("id", F.lit("build")))


@query(f"""WITH {RECORDS}, a AS (SELECT id, stack FROM rec WHERE quality IS NOT NULL), b AS (SELECT id, '_personal' AS stack FROM rec WHERE quality IS NULL) SELECT stack, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY stack""")
def overlay_counts(spark: SparkSession, sf: str) -> DataFrame:
    rec = records(spark, sf)
    return R.with_overlay(rec.filter("quality is not null"), rec.filter("quality is null")).groupBy("stack").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {RECORDS} SELECT id FROM rec WHERE doc_id % 3 <> 2""")
def knowledge_records(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 3 == 1, "knowledge").when(F.col("doc_id") % 3 == 2, "tool")
    return R.knowledge_only(records(spark, sf).withColumn("type", kind)).select("id")


@query(f"""WITH {RECORDS}, s AS (SELECT stack FROM rec GROUP BY stack) SELECT stack, format('stack-{{:03d}}', row_number() OVER (ORDER BY stack) - 1) AS ordinal_id FROM s""")
def stack_ordinals(spark: SparkSession, sf: str) -> DataFrame:
    return G.ordinals(records(spark, sf).select("stack").distinct(), "stack", "stack")


@query(f"""WITH {RECORDS}, v AS (SELECT count(*) AS total_seeds, count(DISTINCT stack) AS stacks, count(*) FILTER (deprecated) AS personal, count(quality) AS refs, avg(confidence) AS conf, avg(CASE WHEN length(symptom) > 0 THEN 1.0 ELSE 0.0 END) AS ratio FROM rec)
    SELECT unnest(['first_stone', 'chiseled', 'geologist', 'polymath', 'seed_author', 'battle_tested', 'well_sourced', 'fully_documented', 'precise', 'validated', 'high_confidence', 'drift_free', 'provenance_rich', 'universal_contributor']) AS achievement,
    unnest([total_seeds >= 10, total_seeds >= 50, total_seeds >= 200, stacks >= 5, personal > 0, personal >= 10, refs / total_seeds >= 0.5, refs / total_seeds >= 0.9, ratio >= 0.95, refs > 0, refs >= 10 AND conf > 0.75, false, personal > 5, false]) AS reached FROM v""")
def achievements(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with labels count as tracked; there is no drift check and no universal stack."""
    from .corpus import _stats

    s = _stats(spark, sf).withColumns({"drift_stale": F.lit(None).cast("int"), "grafted_ratio": F.lit(0.0), "has_universal_stack": F.lit(False)})
    return P.achievements(s)


@query(f"""WITH {RECORDS}, b AS (SELECT doc_id, bool_or(severity = 'high') AS blocking FROM (PRIVACY) WHERE n_matches > 0 GROUP BY doc_id),
    o AS (SELECT rec.doc_id, length(trim(wrong)) >= 20 AND length(trim(correct)) >= 20 AND length(trim(symptom)) >= 20 AND NOT coalesce(blocking, false) AS ok FROM rec LEFT JOIN b USING (doc_id)) SELECT doc_id, ok, bool_and(ok) OVER () AS all_ok FROM o""".replace("(PRIVACY)", f"({__import__('corvane.plans.corpus', fromlist=['x'])._privacy_sql()})"))
def batch_validation(spark: SparkSession, sf: str) -> DataFrame:
    rec = records(spark, sf).join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return P.validated(rec, ["text"], "doc_id")


@query(f"""WITH {RECORDS}, p AS (SELECT stack, doc_id, tag, i FROM (SELECT stack, doc_id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS i FROM rec)), f AS (SELECT stack, tag, min(doc_id * 10 + i) AS pos FROM p GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY stack ORDER BY pos, tag) AS k FROM f),
    h AS (SELECT stack, bool_or(contains(tag, 'an')) AS hit FROM k WHERE k <= 5 GROUP BY stack) SELECT stack, count(*) AS records FROM rec LEFT JOIN h USING (stack) WHERE contains(lower(stack), 'an') OR coalesce(hit, false) GROUP BY stack""")
def stack_search(spark: SparkSession, sf: str) -> DataFrame:
    return P.stacks_matching(records(spark, sf), "an")


@query(f"""WITH {RECORDS} SELECT id, doc_id % 2 = 0 OR coalesce(wrong, '') = '' OR coalesce(correct, '') = '' AS needs FROM rec""")
def migration_needed(spark: SparkSession, sf: str) -> DataFrame:
    full = {c: F.lit("x") for c in R.ENRICHMENT} | {"title": F.when(F.col("doc_id") % 2 == 1, "x"), "content": F.col("wrong"), "summary": F.col("correct")}
    d = records(spark, sf).withColumns(full)
    return d.select("id", P.needs_migration(d.columns).alias("needs"))


@query(f"""WITH {R_.PAIRS}, p AS (SELECT stack, a, b FROM tp JOIN rec ON doc_id = a WHERE s > 0.6), m AS (SELECT stack, a AS m FROM p UNION ALL SELECT stack, b FROM p) SELECT stack, count(DISTINCT m) AS members FROM m GROUP BY stack HAVING count(DISTINCT m) > 5""")
def saturated_stacks(spark: SparkSession, sf: str) -> DataFrame:
    """Stacks with more than five records whose titles have a similarity above 0.6 to another."""
    c = saved(L.title_classes(R_._titled(spark, sf), "doc_id", F.col("title")))
    return twins.with_another(c, twins.links(c, 0.6, "stack").filter("confidence > 0.6"), "stack").filter("members > 5")


@query(f"""WITH {RECORDS}, s AS (SELECT stack, domain, count(*) AS n FROM rec GROUP BY ALL) SELECT stack, domain, n / sum(n) OVER (PARTITION BY stack) > 0.2 AS hold FROM s""")
def concentration_holds(spark: SparkSession, sf: str) -> DataFrame:
    d = records(spark, sf).groupBy("stack", "domain").agg(F.count(F.lit(1)).alias("n"))
    return d.select("stack", "domain", (F.col("n") / F.sum("n").over(Window.partitionBy("stack")) > 0.2).alias("hold"))


@query("""SELECT o_custkey, NOT (max(o_orderdate)::TIMESTAMP > (SELECT max(o_orderdate) FROM orders)::TIMESTAMP - INTERVAL 6 MONTH) AS stale FROM orders GROUP BY o_custkey""")
def unconfirmed(spark: SparkSession, sf: str) -> DataFrame:
    """Customers without an order for six months stand for records that nobody confirmed lately."""
    o = table(spark, sf, "orders").select("o_custkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    last = o.agg(F.max("at").alias("last"))
    return o.groupBy("o_custkey").agg(F.max("at").alias("seen")).join(F.broadcast(last)).select("o_custkey", (~(F.col("seen") > F.col("last") - F.expr("interval 6 months"))).alias("stale"))


@query(f"""SELECT user_id, {r("ln(1 + count(*) / 20.0)")} AS weight, {r("2 * avg(value)")} AS fixation, 2 * avg(value) > 0.5 AS ready, count(*) < 10 AS few FROM events GROUP BY user_id""")
def update_weights(spark: SparkSession, sf: str) -> DataFrame:
    n = F.count(F.lit(1))
    return table(spark, sf, "events").groupBy("user_id").agg(T.round_to(F.log1p(n / 20.0), 6).alias("weight"), T.round_to(2 * F.avg("value"), 6).alias("fixation"), (2 * F.avg("value") > 0.5).alias("ready"), (n < 10).alias("few"))


@query("""WITH x AS (SELECT o_orderkey, ['LABEL_0', 'LABEL_1', 'other'] AS n, (o_orderkey % 97) / 97.0::DOUBLE AS s, o_orderkey % 3 AS k FROM orders) SELECT o_orderkey, floor(CASE k WHEN 1 THEN s WHEN 0 THEN 1 - s ELSE s END * 1e6 + 0.5) / 1e6 AS score FROM x""")
def pair_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A cross-encoder's answer: the score of LABEL_1, else 1 less that of LABEL_0, else the first one."""
    label = F.element_at(F.array(F.lit("LABEL_0"), F.lit("LABEL_1"), F.lit("other")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    d = table(spark, sf, "orders").select("o_orderkey", F.array(F.struct(label.alias("label"), (F.col("o_orderkey") % 97 / F.lit(97.0)).alias("score"))).alias("answer"))
    return d.select("o_orderkey", T.round_to(S.pair_score(F.col("answer")), 6).alias("score"))


@query(f"""WITH {RECORDS}, f AS (SELECT stack, count(*) AS n FROM rec GROUP BY stack), o AS (SELECT ln(n) AS y, ln(row_number() OVER (ORDER BY n DESC, stack)) AS x FROM f), m AS (SELECT {r("regr_slope(y, x)", 3)} AS slope, count(*) AS n FROM o HAVING count(*) >= 5)
    SELECT slope, n AS measured, CASE WHEN slope > -1.0 THEN 'LAMINAR' WHEN slope < -2.5 THEN 'MONOPOLAR' WHEN slope < -2.0 THEN 'SLIGHTLY' ELSE 'HEALTHY' END AS label FROM m""")
def cascade_health(spark: SparkSession, sf: str) -> DataFrame:
    f = records(spark, sf).groupBy("stack").agg(F.count(F.lit(1)).alias("n"))
    o = f.select(F.log("n").alias("y"), F.log(F.row_number().over(Window.orderBy(F.desc("n"), "stack"))).alias("x"))
    m = o.agg(T.round_to(F.regr_slope("y", "x"), 3).alias("slope"), F.count(F.lit(1)).alias("measured")).filter("measured >= 5")
    return m.withColumn("label", F.when(F.col("slope") > -1.0, "LAMINAR").when(F.col("slope") < -2.5, "MONOPOLAR").when(F.col("slope") < -2.0, "SLIGHTLY").otherwise("HEALTHY"))


@query(f"""WITH s AS (SELECT doc_id, {tok('text')} AS t, text FROM documents), w AS (SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source) SELECT source AS stack, n AS records, chars, (SELECT count(*) FROM documents) AS total FROM w""")
def registry_totals(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.groupBy(F.col("source").alias("stack")).agg(F.count(F.lit(1)).alias("records"), F.sum("n_chars").cast("bigint").alias("chars")).join(F.broadcast(d.agg(F.count(F.lit(1)).alias("total"))))


@query(f"""WITH {RECORDS}, x AS (SELECT id, stack, substr(symptom, 1, 200) AS s, substr(wrong, 1, 200) AS w, substr(correct, 1, 150) AS c, array_to_string(tags[1:6], ',') AS t, {SEVERITY_RANK} AS k FROM rec)
    SELECT id, s AS symptom, w AS wrong, c AS correct, t AS tags, row_number() OVER (PARTITION BY stack ORDER BY k, id)::INT AS place FROM x""")
def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Compact projections of records, the most severe of each stack first."""
    place = F.row_number().over(Window.partitionBy("stack").orderBy(S.by_severity(F.col("blast_radius"), S.SEVERITY_RANK), "id"))
    return records(spark, sf).select("id", F.substring("symptom", 1, 200).alias("symptom"), F.substring("wrong", 1, 200).alias("wrong"), F.substring("correct", 1, 150).alias("correct"), F.array_join(F.slice("tags", 1, 6), ",").alias("tags"), place.alias("place"))


@query(f"""WITH {RECORDS}, p AS (SELECT doc_id, symptom, wrong, 'Title ' || id AS title, array_to_string(tags, ' ') AS tags FROM rec WHERE symptom <> '') SELECT doc_id, 'wrong' AS kind, md5(symptom) AS "left", md5(wrong) AS "right" FROM p WHERE wrong <> ''
    UNION ALL SELECT doc_id, 'title', md5(symptom), md5(title) FROM p UNION ALL SELECT doc_id, 'tags', md5(tags), md5(symptom) FROM p WHERE tags <> ''""")
def record_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The three pairs of each record that train a similarity model."""
    d = R.training_pairs(records(spark, sf).withColumn("title", F.concat(F.lit("Title "), "id")), "doc_id")
    return d.select("doc_id", "kind", F.md5(F.col("left").cast("binary")).alias("left"), F.md5(F.col("right").cast("binary")).alias("right"))
