"""Queries of clusters, communities, composed texts and integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import briefs as B
from ..operators import communities as C
from ..operators import graphs as G
from ..operators import hooks as H
from ..sources import payloads, readers
from . import search as Q
from .base import RECORDS, SEVERITY_RANK, query, r, records, table, tok
from .details import KEYS

K, ROUNDS = 4, 3


def _kmeans_sql() -> str:
    """The rounds one after another: assign by inner product, then normalised means; a centroid without members stays."""
    parts = [Q.VEC, f"c0 AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS c, v FROM (SELECT * FROM e ORDER BY doc_id LIMIT {K}))"]
    for i in range(ROUNDS):
        parts.append(f"h{i} AS MATERIALIZED (SELECT doc_id, any_value(e.v) AS v, arg_max(c, (list_inner_product(e.v, c{i}.v), -c)) AS c FROM e, c{i} GROUP BY doc_id)")
        parts.append(f"p{i} AS (SELECT c, p, avg(x) AS x FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM h{i}) GROUP BY c, p)")
        parts.append(f"n{i} AS (SELECT c, list(x ORDER BY p) AS v, sqrt(sum(x * x)) AS l FROM p{i} GROUP BY c)")
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(list_transform(n{i}.v, lambda x: x / l), c{i}.v) AS v FROM c{i} LEFT JOIN n{i} USING (c))")
    return f"WITH {', '.join(parts)} SELECT doc_id, c::INT AS cluster FROM h{ROUNDS - 1}"


@query(_kmeans_sql())
def spherical_kmeans(spark: SparkSession, sf: str) -> DataFrame:
    """Four clusters from the first four vectors, three rounds."""
    v = Q._vectors(spark, sf).select("doc_id", "v")
    seeds = [x[0] for x in v.orderBy("doc_id").limit(K).select("v").collect()]
    return C.spherical_kmeans(v, "doc_id", seeds, rounds=ROUNDS)[0]


@query(f"""WITH {RECORDS}, t AS (SELECT DISTINCT doc_id, unnest(tags) AS tag FROM rec), p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.tag = b.tag AND a.doc_id < b.doc_id GROUP BY ALL HAVING count(*) >= 2),
    e AS (SELECT doc_id AS src, doc_id // 2 AS dst FROM documents) SELECT a, b FROM p UNION SELECT least(src, dst), greatest(src, dst) FROM e WHERE src <> dst""")
def tag_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of tags, and edges to the document with half the number."""
    e = table(spark, sf, "documents").select(F.col("doc_id").alias("src"), F.floor(F.col("doc_id") / 2).alias("dst"))
    return C.tag_graph(records(spark, sf), "doc_id", e)


GROUPS = "CASE WHEN doc_id % 10 < 7 THEN stack ELSE 'small_' || (doc_id // 20) END"


@query(f"""WITH {RECORDS}, m AS (SELECT doc_id, {GROUPS} AS community, tags, count(*) OVER (PARTITION BY {GROUPS}) AS n FROM rec), h AS (SELECT DISTINCT community, unnest(tags) AS tag FROM m WHERE n >= 4),
    t AS (SELECT DISTINCT doc_id, unnest(tags) AS tag FROM m WHERE n < 4), k AS (SELECT doc_id, h.community, count(*) AS k FROM t JOIN h USING (tag) GROUP BY ALL), b AS (SELECT doc_id, arg_max(community, (k, -x)) AS best FROM (SELECT *, row_number() OVER (ORDER BY community) AS x FROM k) GROUP BY doc_id)
    SELECT doc_id, CASE WHEN n >= 4 THEN community ELSE coalesce(best, (SELECT min(community) FROM h), community) END AS community FROM m LEFT JOIN b USING (doc_id)""")
def tiny_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Stacks are the large communities, a few documents with near numbers the tiny ones."""
    c = F.when(F.col("doc_id") % 10 < 7, F.col("stack")).otherwise(F.concat(F.lit("small_"), F.floor(F.col("doc_id") / 20).cast("string")))
    return C.merge_tiny(records(spark, sf).select("doc_id", c.alias("community"), "tags"), "doc_id")


@query(f"""WITH {Q.VEC}, p AS (SELECT label, p, avg(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM e) GROUP BY ALL), l AS (SELECT label, sqrt(sum(x * x)) AS l FROM p GROUP BY label),
    c AS (SELECT label AS community, list(x / l ORDER BY p) AS v FROM p JOIN l USING (label) GROUP BY label), s AS (SELECT doc_id AS query_id, community, {r("list_inner_product(e.v, c.v)")} AS similarity FROM e, c WHERE doc_id % 50 = 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, community)::INT AS rank FROM s) SELECT query_id, rank, community, similarity, rank <= 2 AND similarity >= 0.35 AS in_context FROM k WHERE rank <= 5""")
def community_search(spark: SparkSession, sf: str) -> DataFrame:
    v = Q._vectors(spark, sf)
    c = V.mean_vectors(v, "label", "v")
    c = c.select(F.col("label").alias("community"), F.col([x for x in c.columns if x != "label"][0]).alias("v"))
    return C.search_communities(Q._asked(spark, sf), c)


@query(f"""WITH {RECORDS}, t AS (SELECT stack, tag, min(doc_id * 10 + i) AS pos FROM (SELECT stack, doc_id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS i FROM rec) GROUP BY ALL),
    g AS (SELECT stack, array_to_string(list(tag ORDER BY pos)[1:6], ', ') AS tags FROM t GROUP BY stack), h AS (SELECT stack, count(*) AS n, array_to_string(list(id ORDER BY doc_id)[1:5], '; ') AS titles FROM rec GROUP BY stack)
    SELECT stack, stack || ': Antipatterns covering ' || coalesce(tags, '') || '. Examples: ' || titles || CASE WHEN n > 5 THEN ' (+ ' || (n - 5) || ' more)' ELSE '' END || '.' AS summary FROM h LEFT JOIN g USING (stack)""")
def cluster_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return C.described(records(spark, sf), "stack", "doc_id", "id")


@query(f"""WITH {RECORDS}, t AS (SELECT DISTINCT doc_id, unnest(tags) AS tag FROM rec), n AS (SELECT tag, count(*) AS n FROM t GROUP BY tag),
    p AS (SELECT a.tag AS a, b.tag AS b, count(*) AS together FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.tag < b.tag GROUP BY ALL HAVING count(*) >= 10),
    s AS (SELECT p.*, together / (x.n + y.n - together) AS j, together / greatest(x.n, y.n) AS c FROM p JOIN n x ON x.tag = a JOIN n y ON y.tag = b)
    SELECT a, b, together, {r('j', 2)} AS jaccard, {r('c', 2)} AS min_conditional, {r('0.5 * j + 0.5 * c', 2)} AS confidence FROM s WHERE c >= 0.6""")
def conditional_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Records are the sessions, their tags the items."""
    items = records(spark, sf).select("doc_id", F.explode("tags").alias("tag"))
    return C.conditional_clusters(G.co_occurrence(items, "doc_id", "tag", 10))


@query("""WITH s AS (SELECT l_partkey AS id, sum(l_quantity)::DOUBLE AS q, sum(l_extendedprice)::DOUBLE AS p FROM lineitem GROUP BY l_partkey), x AS (SELECT id, q / sum(q) OVER () AS actual, p / sum(p) OVER () AS nash, count(*) OVER () AS n FROM s)
    SELECT id, nash > 3 / n AS dominant, actual > 2 * nash AS over, actual < 0.3 * nash AND nash > 0.5 / n AS under FROM x""")
def strategy_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of the quantity against shares of the price stand for what is injected and the equilibrium."""
    s = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.sum("l_quantity").cast("double").alias("q"), F.sum("l_extendedprice").cast("double").alias("p"))
    t = s.agg(F.sum("q").alias("tq"), F.sum("p").alias("tp"), F.count(F.lit(1)).alias("n"))
    d = s.join(F.broadcast(t)).select("id", (F.col("q") / F.col("tq")).alias("actual"), (F.col("p") / F.col("tp")).alias("nash"), "n")
    return C.strategy_labels(d, F.col("n"))


def _cut(c: str) -> str:
    return f"substr(trim(coalesce({c}, '')), 1, 160)"


@query(f"""WITH {RECORDS}, x AS (SELECT stack, id, blast_radius AS s, 'Title ' || id AS t, {_cut('wrong')} AS w, {_cut('correct')} AS c, {_cut('symptom')} AS y, array_to_string({KEYS.replace('coalesce(text', 'coalesce(symptom')}[1:3], ' · ') AS k, row_number() OVER (PARTITION BY stack, blast_radius ORDER BY id)::INT AS place FROM rec),
    l AS (SELECT stack, s AS part, place, CASE s WHEN 'medium' THEN '· ' || t || CASE WHEN y <> '' THEN ' — ' || substr(y, 1, 100) ELSE '' END
        ELSE concat_ws(' ', '[' || t || ']', CASE WHEN w <> '' THEN 'WRONG: ' || w END, CASE WHEN c <> '' THEN 'CORRECT: ' || c END, CASE WHEN y <> '' THEN 'Symptom: ' || y END) END AS line FROM x WHERE s = 'critical' OR s IN ('high', 'medium') AND place <= 4),
    q AS (SELECT stack, 'lookup' AS part, row_number() OVER (PARTITION BY stack ORDER BY {SEVERITY_RANK.replace('blast_radius', 's')}, id)::INT AS place, id, k, s FROM x WHERE y <> '')
    SELECT stack, part, place, md5(line) AS line FROM l UNION ALL SELECT stack, part, place, md5('"' || k || '" → ' || id || ' [' || s || ']') FROM q WHERE place <= 12 AND k <> ''""")
def session_brief(spark: SparkSession, sf: str) -> DataFrame:
    d = records(spark, sf).withColumn("title", F.concat(F.lit("Title "), "id"))
    return B.session_brief(d, "title").select("stack", "part", "place", F.md5(F.col("line").cast("binary")).alias("line"))


@query(f"""WITH {RECORDS}, x AS (SELECT CASE doc_id % 8 WHEN 0 THEN 'security' WHEN 1 THEN 'data-loss' WHEN 2 THEN 'concurrency' WHEN 3 THEN 'performance' WHEN 4 THEN 'readability' ELSE 'correctness' END AS category, length(concat(wrong, correct, symptom)) AS n FROM rec)
    SELECT 'seeds-' || category || '.md' AS path, category, count(*) AS records, sum(n)::BIGINT AS chars FROM x GROUP BY category""")
def category_files(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("security", "data-loss", "concurrency", "performance", "readability", "other", "correctness")])
    return B.category_files(records(spark, sf), F.get(names, (F.col("doc_id") % 8).cast("int")))


@query("""WITH o AS (SELECT n_name AS slug, n_nationkey AS place FROM nation), n AS (SELECT r_name AS slug, r_regionkey AS place FROM region UNION ALL SELECT n_name, n_nationkey + 100 FROM nation WHERE n_nationkey % 7 = 0)
    SELECT slug, row_number() OVER (ORDER BY old, place, slug)::INT AS place FROM (SELECT *, 0 AS old FROM n UNION ALL SELECT *, 1 FROM o WHERE slug NOT IN (SELECT slug FROM n))""")
def project_list(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation")
    old = nation.select(F.col("n_name").alias("slug"), F.col("n_nationkey").cast("int").alias("place"))
    new = table(spark, sf, "region").select(F.col("r_name").alias("slug"), F.col("r_regionkey").cast("int").alias("place")).union(nation.filter("n_nationkey % 7 = 0").select("n_name", (F.col("n_nationkey") + 100).cast("int")))
    return B.newest_first(old, new)


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 5 > 0 THEN least(10, greatest(0, (l_partkey % 14) - 2)) / 10.0 ELSE 0 END AS s FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL))
    SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber > 3, CASE WHEN l_linenumber <= 3 THEN -s END, l_linenumber)::INT AS new_rank FROM x""")
def reranked_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """Orders are queries, lines their candidates; the first three are judged."""
    score = F.when(F.col("l_partkey") % 5 > 0, (F.col("l_partkey") % 14 - 2).cast("double"))
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"))
    return B.reranked(lines, "l_orderkey", "l_linenumber", score, most=3).select("l_orderkey", "l_linenumber", "new_rank")


@query("""SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey""")
def latest_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The last of the rows with one key wins."""
    return B.latest(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@query("""SELECT event_id, coalesce(n_name, (user_id % 40)::VARCHAR) AS source_name FROM events LEFT JOIN nation ON n_nationkey = user_id % 40""")
def source_names(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("source_id"), F.col("n_name").alias("name"))
    return B.named_sources(table(spark, sf, "events").select("event_id", (F.col("user_id") % 40).alias("source_id")), s).select("event_id", "source_name")


@query(f"""WITH {RECORDS} SELECT id, 'community' AS source, 'unverified' AS verification_status, CASE WHEN doc_id % 2 = 0 THEN 'first (2026-01-01) → ' ELSE '' END || stack || ' (2026-02-03)' AS chain FROM rec""")
def grazed_records(spark: SparkSession, sf: str) -> DataFrame:
    """Private records that are shared, then taken over by another library; every second one had been before."""
    step = F.struct(F.lit("first").alias("jar"), F.lit("2026-01-01").alias("date"))
    d = records(spark, sf).withColumns({"captured_at": F.lit("2026"), "project": F.lit("p"), "verification_status": F.lit("steward-verified"), "grazed_from": F.when(F.col("doc_id") % 2 == 0, F.array(step))})
    d = B.grazed(B.shared_chunks(d), "grazed_from", F.col("stack"), F.lit("2026-02-03"))
    return d.select("id", "source", "verification_status", T.provenance_chain(F.col("grazed_from")).alias("chain"))


@query(f"""WITH {Q.EDGES}, s AS (SELECT (SELECT count(quality) FROM rec) AS tracked, (SELECT count(DISTINCT src) FROM p) AS nodes, (SELECT count(*) FROM p) AS edges) SELECT unnest(['distribution', 'entropy', 'graph']) AS tier, unnest([tracked >= 5, tracked >= 15, nodes >= 20 AND edges >= 30]) AS ready FROM s""")
def readiness(spark: SparkSession, sf: str) -> DataFrame:
    e = Q.tag_degrees(spark, sf).agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("degree"), F.lit(0)).alias("edges"))
    return B.readiness(records(spark, sf).agg(F.count("quality").alias("tracked")).join(F.broadcast(e)))


@query(f"""WITH {RECORDS}, post AS (SELECT DISTINCT id FROM (SELECT CASE WHEN doc_id % 9 = 0 THEN 'x' || id ELSE id END AS id, unnest({tok('symptom')}) AS t FROM rec)), ends AS (SELECT DISTINCT unnest([id, 'doc_' || (doc_id * 2)]) AS id FROM rec)
    SELECT 'null_id' AS "check", 0 AS failures UNION ALL SELECT 'repeated_id', (SELECT count(*) FROM (SELECT id FROM rec GROUP BY id HAVING count(*) > 1))
    UNION ALL SELECT 'missing_section', (SELECT count(*) FROM rec WHERE trim(coalesce(wrong, '')) = '' OR trim(coalesce(correct, '')) = '' OR trim(coalesce(symptom, '')) = '')
    UNION ALL SELECT 'not_indexed', (SELECT count(*) FROM rec WHERE len({tok('symptom')}) > 0 AND id NOT IN (SELECT id FROM post))
    UNION ALL SELECT 'unknown_posting', (SELECT count(*) FROM post WHERE id NOT IN (SELECT id FROM rec)) UNION ALL SELECT 'unknown_edge_end', (SELECT count(*) FROM ends WHERE id NOT IN (SELECT id FROM rec))""")
def integrity_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Every ninth record is indexed under a wrong id, and edges lead to the document with twice the number."""
    rec = records(spark, sf)
    posts = rec.select(F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("x"), "id")).otherwise(F.col("id")).alias("id"), F.explode(T.tokens(F.col("symptom"))).alias("token"))
    edges = rec.select(F.col("id").alias("src"), F.concat(F.lit("doc_"), (F.col("doc_id") * 2).cast("string")).alias("dst"))
    return B.integrity(rec, posts, edges)


@query("""WITH a AS (SELECT l_orderkey AS query_id, l_partkey AS doc_id, max(l_discount)::DOUBLE * 4 AS score FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL), b AS (SELECT l_orderkey AS query_id, l_partkey AS doc_id, max(l_tax)::DOUBLE AS score FROM lineitem GROUP BY ALL),
    w AS (SELECT query_id, count(*) FILTER (score > 0.3) AS n FROM a GROUP BY query_id) SELECT query_id, doc_id, floor(score * 1e6 + 0.5) / 1e6 AS score FROM a UNION ALL
    SELECT b.query_id, b.doc_id, floor(b.score * 1e6 + 0.5) / 1e6 FROM b LEFT JOIN w USING (query_id) WHERE coalesce(n, 0) < 2 AND NOT EXISTS (SELECT 1 FROM a WHERE a.query_id = b.query_id AND a.doc_id = b.doc_id)""")
def supplemented_hits(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").withColumnsRenamed({"l_orderkey": "query_id", "l_partkey": "doc_id"})  # noqa: E741
    one = lambda d, c, by: d.groupBy("query_id", "doc_id").agg((F.max(c).cast("double") * by).alias("score"))
    return B.supplemented(one(l.filter("l_linenumber <= 3"), "l_discount", 4), one(l, "l_tax", 1)).withColumn("score", T.round_to(F.col("score"), 6))


@query(f"""WITH {RECORDS}, t AS (SELECT DISTINCT doc_id, domain AS stack, unnest(tags) AS tag FROM rec), n AS (SELECT domain AS stack, count(*) AS n FROM rec GROUP BY domain) SELECT stack, tag, {r('count(*) / any_value(n)')} AS share FROM t JOIN n USING (stack) GROUP BY stack, tag HAVING count(*) > 0.1 * any_value(n)""")
def tag_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return B.tag_alerts(records(spark, sf).drop("stack").withColumnRenamed("domain", "stack"), "doc_id", share=0.1)


@query("""WITH l AS (SELECT l_orderkey, l_suppkey % 50 AS term, max(l_quantity::DOUBLE / 10 - 2.5) AS x FROM lineitem GROUP BY ALL) SELECT l_orderkey, term, floor(ln(1 + greatest(0, x)) * 1000 + 0.5) / 1000 AS weight FROM l WHERE ln(1 + greatest(0, x)) > 0.001""")
def sparse_activations(spark: SparkSession, sf: str) -> DataFrame:
    """Lines stand for positions, their quantities for logits."""
    d = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 50).alias("term"), (F.col("l_quantity").cast("double") / 10 - 2.5).alias("x"))
    return H.activations(d, "l_orderkey", "term", "x")


@query("""WITH e AS (SELECT event_id, user_id, value, CASE WHEN value / 100.0 >= 0.30 THEN 1 WHEN value / 100.0 < 0.25 THEN 0 END AS m FROM events) SELECT event_id, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0) = 1 AS active FROM e""")
def held_phases(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", H.held_phase(F.col("value") / 100.0, "user_id", "event_id").alias("active"))


@query(f"""WITH {RECORDS}, t AS (SELECT stack, tag, min(doc_id * 10 + i) AS pos FROM (SELECT stack, doc_id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS i FROM rec) GROUP BY ALL),
    g AS (SELECT stack, array_to_string(list(tag ORDER BY pos)[1:5], ',') AS tags FROM t GROUP BY stack) SELECT stack, count(*) AS records, any_value(coalesce(g.tags, '')) AS tags FROM rec LEFT JOIN g USING (stack) GROUP BY stack""")
def stack_listing(spark: SparkSession, sf: str) -> DataFrame:
    return readers.stack_listing(records(spark, sf), "doc_id").select("stack", "records", F.array_join("tags", ",").alias("tags"))


@query(f"""WITH {RECORDS} SELECT coalesce(CASE WHEN doc_id % 7 > 0 THEN domain END, 'unclassified') AS domain, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, coalesce(CASE WHEN doc_id % 7 > 0 THEN domain END, 'unclassified'))::INT AS rank FROM rec GROUP BY 1 QUALIFY rank <= 10""")
def top_domains(spark: SparkSession, sf: str) -> DataFrame:
    """The ten largest domains; records without one are unclassified (every seventh here)."""
    d = F.coalesce(F.when(F.col("doc_id") % 7 > 0, F.col("domain")), F.lit("unclassified"))
    n = records(spark, sf).groupBy(d.alias("domain")).agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "domain").limit(10).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "domain")))


@query(f"""WITH {RECORDS} SELECT coalesce(CASE WHEN quality IS NOT NULL THEN blast_radius END, 'unset') AS blast_radius, count(*) AS n, {r("avg((confidence IS NOT NULL AND deprecated)::INT)")} AS grafted_ratio FROM rec GROUP BY 1""")
def blast_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """Severities with those unset (records without a label here), and the share of grafted records (deprecated ones with a confidence)."""
    d = records(spark, sf).withColumn("s", F.coalesce(F.when(F.col("quality").isNotNull(), F.col("blast_radius")), F.lit("unset")))
    grafted = (F.col("confidence").isNotNull() & F.col("deprecated")).cast("int")
    return d.groupBy(F.col("s").alias("blast_radius")).agg(F.count(F.lit(1)).alias("n"), T.round_to(F.avg(grafted), 6).alias("grafted_ratio"))


@query("""SELECT doc_id, md5('{"q":' || to_json(coalesce(text, ''))::VARCHAR || ',"k":5}') AS body FROM documents""")
def request_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies of requests that ask for whole documents."""
    body = payloads.request_body('{"q":"{{query}}","k":{{top_k}}}', F.col("text"), 5)
    return table(spark, sf, "documents").select("doc_id", F.md5(body.cast("binary")).alias("body"))
