"""Queries of session analytics, scoring, sources and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..functions import vectors as V
from ..operators import graphs as G
from ..operators import sessions as O
from ..sources import payloads
from .base import dtok, query, r, table, tok


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """Orders stand for sessions, their lines for injected items: N lines are cited, R lines contradicted, F orders clean, P orders untracked."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    d = table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return d.select(
        F.col("l_orderkey").alias("session"), F.col("l_partkey").alias("item"), F.col("l_linenumber").alias("rank"), (F.col("l_returnflag") == "N").alias("cited"), (F.col("l_returnflag") == "R").alias("contradicted"),
        (F.col("o_orderstatus") == "F").alias("clean"), (F.col("o_orderstatus") != "P").alias("tracked"), F.col("o_orderdate").alias("recorded_at"), F.col("l_linestatus").alias("stack"),
    )


ITEMS = """it AS (SELECT l_orderkey AS session, l_partkey AS item, l_linenumber AS rank, l_returnflag = 'N' AS cited, l_returnflag = 'R' AS contradicted, o_orderstatus = 'F' AS clean, o_orderstatus <> 'P' AS tracked, o_orderdate AS recorded_at, l_linestatus AS stack
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
SESSIONS = f"""{ITEMS}, se AS (SELECT session, recorded_at, count(*) AS n_injected, CASE WHEN bool_or(tracked) THEN (sum(cited::INT) > 0)::INT::DOUBLE END AS hit, CASE WHEN bool_or(tracked) THEN avg(cited::INT) END AS precision,
    1 / min(CASE WHEN cited THEN rank END) AS reciprocal_rank, CASE WHEN sum(cited::INT) + sum(contradicted::INT) > 0 THEN sum(cited::INT) / (sum(cited::INT) + sum(contradicted::INT)) END AS recall, bool_or(clean)::INT::DOUBLE AS clean FROM it GROUP BY session, recorded_at)"""
AVERAGES = ", ".join(f"{r(f'avg({c})')} AS {name}" for c, name in O.MEASURES.items())


@query("SELECT o_orderkey AS session FROM orders WHERE o_orderstatus = 'F' OR o_orderstatus IS NULL")
def clean_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").filter("o_orderstatus = 'F' or o_orderstatus is null").select(F.col("o_orderkey").alias("session"))


@query(f"""WITH {ITEMS}, d AS (SELECT DISTINCT session, item FROM it WHERE clean), n AS (SELECT item, count(*) AS n FROM d GROUP BY item), p AS (SELECT a.item AS a, b.item AS b, count(*) AS together FROM d a JOIN d b ON a.session = b.session AND a.item < b.item GROUP BY ALL HAVING together >= 2)
    SELECT a, b, together, {r("0.5 * together / (x.n + y.n - together) + 0.5 * least(together / x.n, together / y.n)")} AS confidence FROM p JOIN n x ON x.item = a JOIN n y ON y.item = b""")
def co_occurrence(spark: SparkSession, sf: str) -> DataFrame:
    d = G.co_occurrence(_items(spark, sf).filter("clean"), "session", "item", 2)
    j = F.col("together") / (F.col("n_a") + F.col("n_b") - F.col("together"))
    least = F.least(F.col("together") / F.col("n_a"), F.col("together") / F.col("n_b"))
    return d.select("a", "b", "together", T.round_to(0.5 * j + 0.5 * least, 6).alias("confidence"))


BORRO = """d AS (SELECT DISTINCT l_orderkey AS session, l_suppkey AS item FROM lineitem), n AS (SELECT item, count(*) AS n FROM d GROUP BY item), p AS (SELECT a.item AS a, b.item AS b, count(*) AS k FROM d a JOIN d b ON a.session = b.session AND a.item < b.item GROUP BY ALL),
    t AS (SELECT a.item AS a, b.item AS b, c.item AS c, count(*) AS k FROM d a JOIN d b ON a.session = b.session AND a.item < b.item JOIN d c ON c.session = b.session AND b.item < c.item GROUP BY ALL HAVING k >= 3)"""


@query(f"""WITH {BORRO}, s AS (SELECT t.a, t.b, t.c, t.k, t.k / (x.n + y.n + z.n - ab.k - ac.k - bc.k + t.k) AS j3, greatest(ab.k / (x.n + y.n - ab.k), ac.k / (x.n + z.n - ac.k), bc.k / (y.n + z.n - bc.k)) AS j2
    FROM t JOIN n x ON x.item = t.a JOIN n y ON y.item = t.b JOIN n z ON z.item = t.c JOIN p ab ON ab.a = t.a AND ab.b = t.b JOIN p ac ON ac.a = t.a AND ac.b = t.c JOIN p bc ON bc.a = t.b AND bc.b = t.c)
    SELECT a, b, c, k AS together, {r("j3 / j2")} AS ratio, CASE WHEN {r("j3 / j2")} > 2 THEN 'strong' WHEN {r("j3 / j2")} > 1.2 THEN 'weak' ELSE 'none' END AS kind FROM s""")
def borromean(spark: SparkSession, sf: str) -> DataFrame:
    """Triples of items that occur together more than their pairs explain; the suppliers of an order's lines are its items."""
    d = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("session"), F.col("l_suppkey").alias("item"))
    t = G.triple_occurrence(d, "session", "item", 3)
    p = G.co_occurrence(d, "session", "item", 3)  # the pairs of a triple are seen as often as it is
    pair = lambda x, y: p.select(F.col("a").alias(x), F.col("b").alias(y), F.col("together").alias(f"k_{x}{y}"), F.col("n_a").alias(f"n_{x}_{x}{y}"), F.col("n_b").alias(f"n_{y}_{x}{y}"))
    d = t.join(pair("a", "b"), ["a", "b"]).join(pair("a", "c"), ["a", "c"]).join(pair("b", "c"), ["b", "c"])
    na, nb, nc = F.col("n_a_ab"), F.col("n_b_ab"), F.col("n_c_ac")
    j3 = F.col("together") / (na + nb + nc - F.col("k_ab") - F.col("k_ac") - F.col("k_bc") + F.col("together"))
    j2 = F.greatest(F.col("k_ab") / (na + nb - F.col("k_ab")), F.col("k_ac") / (na + nc - F.col("k_ac")), F.col("k_bc") / (nb + nc - F.col("k_bc")))
    d = d.withColumn("ratio", T.round_to(j3 / j2, 6))
    return d.select("a", "b", "c", "together", "ratio", F.when(F.col("ratio") > 2, "strong").when(F.col("ratio") > 1.2, "weak").otherwise("none").alias("kind"))


@query(f"WITH {SESSIONS} SELECT count(*) AS sessions, {AVERAGES} FROM se")
def retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return O.session_measures(_items(spark, sf), "session", "recorded_at").agg(F.count(F.lit(1)).alias("sessions"), *O.averages(T.round_to))


@query(f"""WITH {SESSIONS}, leg AS (SELECT DISTINCT session, stack FROM it) SELECT 'month' AS leg, strftime(recorded_at, '%Y-%m') AS key, count(*) AS sessions, {AVERAGES} FROM se GROUP BY 2
    UNION ALL SELECT 'total', 'all', count(*), {AVERAGES} FROM se UNION ALL SELECT 'stack', stack, count(*), {AVERAGES} FROM se JOIN leg USING (session) GROUP BY stack""")
def metrics_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Totals and months by grouping sets; stacks by a leg in which a session counts for each stack it touches."""
    items = _items(spark, sf)
    se = O.session_measures(items, "session", "recorded_at").withColumn("month", F.date_format("recorded_at", "yyyy-MM"))
    aggs = [F.count(F.lit(1)).alias("sessions"), *O.averages(T.round_to)]
    sets = se.rollup("month").agg(F.grouping("month").alias("_g"), *aggs)
    names = ["leg", "key", "sessions", *O.MEASURES.values()]
    one = sets.withColumns({"leg": F.when(F.col("_g") == 1, "total").otherwise("month"), "key": F.when(F.col("_g") == 1, "all").otherwise(F.col("month"))}).select(*names)
    stacks = se.join(items.select("session", "stack").distinct(), "session").groupBy(F.col("stack").alias("key")).agg(*aggs).withColumn("leg", F.lit("stack"))
    return one.union(stacks.select(*names))


@query(f"""WITH {SESSIONS}, a AS (SELECT {AVERAGES} FROM se WHERE recorded_at >= TIMESTAMP '1996-01-01'), b AS (SELECT {AVERAGES} FROM se WHERE recorded_at < TIMESTAMP '1996-01-01'),
    x AS (UNPIVOT a ON COLUMNS(*) INTO NAME metric VALUE v), y AS (UNPIVOT b ON COLUMNS(*) INTO NAME metric VALUE v) SELECT metric, x.v AS current, y.v AS baseline, {r("x.v - y.v")} AS delta FROM x FULL JOIN y USING (metric)""")
def metrics_vs_baseline(spark: SparkSession, sf: str) -> DataFrame:
    se = O.session_measures(_items(spark, sf), "session", "recorded_at")
    cut = F.lit("1996-01-01").cast("timestamp")
    side = lambda cond, name: se.filter(cond).agg(*O.averages(T.round_to)).unpivot([], list(O.MEASURES.values()), "metric", name)
    d = side(F.col("recorded_at") >= cut, "current").join(side(F.col("recorded_at") < cut, "baseline"), "metric", "full")
    return d.select("metric", "current", "baseline", T.round_to(F.col("current") - F.col("baseline"), 6).alias("delta"))


@query(f"SELECT user_id, count(*) AS injections, sum((event_type = 'purchase')::INT)::BIGINT AS clean_after, {r('(sum((event_type = $$purchase$$)::INT) + 1) / (count(*) + 2)')} AS confidence FROM events GROUP BY user_id".replace("$$", "'"))
def laplace_confidence(spark: SparkSession, sf: str) -> DataFrame:
    good = F.count_if(F.col("event_type") == "purchase")
    return table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("injections"), good.alias("clean_after"), T.round_to(S.laplace(good, F.count(F.lit(1))), 6).alias("confidence"))


@query(f"""WITH p AS (SELECT user_id, (sum((event_type = 'purchase')::INT) + 1) / (count(*) + 2) AS p FROM events GROUP BY user_id) SELECT count(*) AS n, {r("-avg(p * ln(p) + (1 - p) * ln(1 - p)) / ln(2)")} AS entropy FROM p WHERE p > 0.001 AND p < 0.999 HAVING count(*) >= 15""")
def bernoulli_entropy(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "events").groupBy("user_id").agg(S.laplace(F.count_if(F.col("event_type") == "purchase"), F.count(F.lit(1))).alias("p")).filter("p > 0.001 and p < 0.999")
    h = F.col("p") * F.log("p") + (1 - F.col("p")) * F.log1p(-F.col("p"))
    return p.agg(F.count(F.lit(1)).alias("n"), T.round_to(-F.avg(h) / F.log(F.lit(2.0)), 6).alias("entropy")).filter("n >= 15")


@query(f"""WITH c AS (SELECT user_id % 10 AS g, event_type, count(*)::DOUBLE AS n FROM events GROUP BY ALL), t AS (SELECT event_type, sum(n) / (SELECT sum(n) FROM c) AS q FROM c GROUP BY event_type), s AS (SELECT g, event_type, n / sum(n) OVER (PARTITION BY g) AS p FROM c)
    SELECT g, {r("sum(p * ln(greatest(p, 1e-10) / greatest(q, 1e-10)))")} AS divergence FROM s JOIN t USING (event_type) GROUP BY g""")
def kl_divergence(spark: SparkSession, sf: str) -> DataFrame:
    """How far each group's mix of events is from the overall one."""
    c = table(spark, sf, "events").groupBy((F.col("user_id") % 10).alias("g"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    q = c.groupBy("event_type").agg(F.sum("n").alias("nq")).withColumn("q", F.col("nq") / F.sum("nq").over(Window.partitionBy()))
    s = c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("g"))).join(F.broadcast(q.select("event_type", "q")), "event_type")
    return s.groupBy("g").agg(T.round_to(F.sum(F.col("p") * F.log(F.greatest(F.col("p"), F.lit(1e-10)) / F.greatest(F.col("q"), F.lit(1e-10)))), 6).alias("divergence"))


SAV = "least(sim * 0.35 * f * 1800, greatest(0, 200000 - used) * 0.3)"
THR = "140 * (1 + 2 * pow(used / 200000, 2))"
SMOOTH = "least(ln(1 + sim * exp(1)) / ln(1 + exp(1)) * 0.35 * f * 1800 * sqrt(greatest(0.05, 0.5)), greatest(0, 200000 - used) * 0.3)"
PARTS = "p AS (SELECT p_partkey, (p_partkey % 100) / 100.0::DOUBLE AS sim, (p_partkey % 7) * 30000::DOUBLE AS used, CASE WHEN p_size > 40 THEN 7 WHEN p_size > 25 THEN 2.5 WHEN p_size > 10 THEN 1 ELSE 0.5 END::DOUBLE AS f FROM part)"


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts stand for candidate records: similarity, tokens used and severity come from key and size."""
    sev = F.when(F.col("p_size") > 40, "critical").when(F.col("p_size") > 25, "high").when(F.col("p_size") > 10, "medium").otherwise("low")
    return table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 100 / 100.0).alias("sim"), ((F.col("p_partkey") % 7) * F.lit(30000.0)).alias("used"), sev.alias("severity"))


@query(f"WITH {PARTS} SELECT p_partkey, {r(f'1 / (1 + exp(-0.03 * ({SAV} - {THR})))', 3)} AS inject_weight, floor({SAV} + 0.5)::BIGINT AS expected_savings, floor({THR} + 0.5)::BIGINT AS threshold, 1 / (1 + exp(-0.03 * ({SAV} - {THR}))) > 0.5 AS inject FROM p")
def injection_value(spark: SparkSession, sf: str) -> DataFrame:
    d = _parts(spark, sf)
    return d.select("p_partkey", S.injection_value(F.col("sim"), F.col("severity"), F.col("used")).alias("v")).select("p_partkey", "v.inject_weight", "v.expected_savings", "v.threshold", "v.inject")


@query(f"WITH {PARTS} SELECT p_partkey, {r(f'1 / (1 + exp(-0.03 * ({SMOOTH} - 140 * exp(used / 200000 * ln(3)))))', 3)} AS inject_weight, floor({SMOOTH} + 0.5)::BIGINT AS expected_savings FROM p")
def injection_value_smooth(spark: SparkSession, sf: str) -> DataFrame:
    d = _parts(spark, sf)
    return d.select("p_partkey", S.smooth_injection_value(F.col("sim"), F.col("severity"), F.col("used"), F.lit(0.5)).alias("v")).select("p_partkey", "v.inject_weight", "v.expected_savings")


@query(f"SELECT o_orderkey, {r('CASE WHEN s IS NULL THEN 0.5 WHEN s > 1 THEN 1 / (1 + exp(-(s - 1))) WHEN s < 0 THEN greatest(0, s + 1) ELSE s END')} AS score FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_orderkey % 50 - 20) / 10.0::DOUBLE END AS s FROM orders)")
def score_normalise(spark: SparkSession, sf: str) -> DataFrame:
    s = F.when(F.col("o_orderkey") % 11 != 0, (F.col("o_orderkey") % 50 - 20) / 10.0)
    return table(spark, sf, "orders").select("o_orderkey", T.round_to(S.normalised_score(s), 6).alias("score"))


@query("SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k FROM events")
def json_dig(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.coalesce(payloads.dig(F.col("props"), "k").cast("bigint"), F.lit(-1)).alias("k"))


@query(f"""WITH q AS (SELECT conv_id, turn, unnest({dtok('text', T.STOP_ATTRIBUTION)}) AS token FROM conversations WHERE role = 'assistant'), c AS (SELECT item_id, len({tok('text', T.STOP_ATTRIBUTION)}) AS n, unnest({tok('text', T.STOP_ATTRIBUTION)}) AS token FROM benchmark),
    s AS (SELECT conv_id, turn, item_id, {r("count(*) / n")} AS recall FROM q JOIN c USING (token) GROUP BY conv_id, turn, item_id, n)
    SELECT conv_id * 1000 + turn AS response, rank, item_id, recall FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY recall DESC, item_id)::INT AS rank FROM s WHERE recall >= 0.15) WHERE rank <= 5""")
def attribution(spark: SparkSession, sf: str) -> DataFrame:
    """Which benchmark passages an assistant's turns draw on."""
    c = table(spark, sf, "benchmark").select("item_id", F.explode(T.tokens(F.col("text"), T.STOP_ATTRIBUTION)).alias("token"))
    q = table(spark, sf, "conversations").filter("role = 'assistant'")
    q = q.select((F.col("conv_id") * 1000 + F.col("turn")).alias("response"), F.explode(T.distinct_tokens(F.col("text"), T.STOP_ATTRIBUTION)).alias("token"))
    return O.attribution(q, c, "item_id", "response")


@query("""WITH it AS (SELECT l_orderkey AS session, l_partkey AS item, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank, l_quantity FROM lineitem), rec AS (SELECT session, item, min(rank) AS rank FROM it GROUP BY ALL), inj AS (SELECT DISTINCT session, item FROM it WHERE l_quantity > 25),
    f AS (SELECT session, item, row_number() OVER (PARTITION BY session ORDER BY rank) AS n FROM rec ANTI JOIN inj USING (session, item)), c AS (SELECT session, count(*) AS n FROM inj GROUP BY session), near AS (SELECT session, item FROM rec JOIN c USING (session) WHERE rank <= 5 + greatest(n, 5))
    SELECT session, item, 'new' AS change FROM f WHERE n <= 5 UNION ALL SELECT session, item, 'retired' FROM inj ANTI JOIN near USING (session, item)""")
def session_diff(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber"))
    d = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("session"), F.col("l_partkey").alias("item"), rank.alias("rank"), "l_quantity")
    return O.session_diff(d.groupBy("session", "item").agg(F.min("rank").alias("rank")), d.filter("l_quantity > 25").select("session", "item").distinct(), "session", "item")


@query(f"""WITH e AS (SELECT vec_id // 10 AS session, vec_id, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT session, vec_id, row_number() OVER w AS call, greatest(0, least(1, 1 - list_inner_product(first_value(v) OVER w, v))) AS x FROM e WINDOW w AS (PARTITION BY session ORDER BY vec_id))
    SELECT session, vec_id, {r("x")} AS distance, call > 3 AND x > 0.35 AS drifted FROM d""")
def drift(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("session"), "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return O.drift(e, "session", "vec_id", "v").select("session", "vec_id", T.round_to(F.col("distance"), 6).alias("distance"), "drifted")


@query(f"""WITH c AS (SELECT DISTINCT doc_id, unnest({tok('text')}) AS token FROM documents), n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id), s AS (SELECT DISTINCT item_id, unnest({tok('text')}) AS token FROM benchmark), m AS (SELECT item_id, count(*) AS m FROM s GROUP BY item_id),
    j AS (SELECT doc_id, count(*) / (n + m - count(*)) AS j FROM c JOIN s USING (token) JOIN n USING (doc_id) JOIN m USING (item_id) GROUP BY doc_id, item_id, n, m), f AS (SELECT doc_id, sum(j / (1 - j + 1e-9)) AS f FROM j GROUP BY doc_id),
    x AS (SELECT d.doc_id, d.source, exp(-length(text) / 800) AS fit, coalesce(quality, 0.5)::DOUBLE AS rel, greatest(0, 1 - coalesce(f, 0) / (SELECT greatest(1, count(DISTINCT item_id)) FROM s)) AS nov FROM documents d LEFT JOIN labels USING (doc_id) LEFT JOIN f USING (doc_id) WHERE d.doc_id IN (SELECT doc_id FROM n)),
    y AS (SELECT *, CASE WHEN rel > 0 THEN 2 * rel * 0.6 / (rel + 0.6) ELSE 0 END AS cert FROM x), z AS (SELECT *, {r("cert")} AS certainty, {r("nov")} AS novelty FROM y WHERE cert > 0.2 AND nov > 0.2 AND fit > 0.3),
    k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY certainty DESC, doc_id) AS n FROM z), g AS (SELECT *, row_number() OVER (ORDER BY certainty DESC, doc_id)::INT AS rank FROM k WHERE n <= 3)
    SELECT doc_id, source, certainty, novelty, rank FROM g WHERE rank <= 6""")
def homeostasis_bridge(spark: SparkSession, sf: str) -> DataFrame:
    """External chunks that pass certainty, novelty and fit: three of a source, six in all."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    c = docs.select("doc_id", F.explode(T.distinct_tokens(F.col("text"))).alias("token"))
    s = table(spark, sf, "benchmark").select(F.col("item_id").alias("set"), F.explode(T.distinct_tokens(F.col("text"))).alias("token"))
    d = docs.join(O.novelty(c, s, "doc_id"), "doc_id")
    d = d.withColumn("cert", S.certainty(F.coalesce("quality", F.lit(0.5)).cast("double"), F.lit(0.6)))
    d = d.filter((F.col("cert") > 0.2) & (F.col("novelty") > 0.2) & (S.session_fit(F.col("text")) > 0.3))
    d = d.select("doc_id", "source", T.round_to(F.col("cert"), 6).alias("certainty"), T.round_to(F.col("novelty"), 6).alias("novelty"))
    d = d.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("certainty"), "doc_id"))).filter("n <= 3").drop("n")
    return d.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("certainty"), "doc_id"))).filter("rank <= 6")


@query(f"""SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS n, {r("sum(value)", 2)} AS total FROM events GROUP BY ALL""")
def month_trend(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "event_type").agg(F.count(F.lit(1)).alias("n"), T.round_to(F.sum("value"), 2).alias("total"))


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY ALL""")
def events_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "events").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM o)
    SELECT user_id, count(DISTINCT n) AS sessions, count(*) AS events FROM s GROUP BY user_id""")
def events_sessionize(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts")
    fresh = F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("interval 6 hours"), 0).otherwise(1)
    d = table(spark, sf, "events").select("user_id", "ts", fresh.alias("fresh")).withColumn("n", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy("user_id").agg(F.count_distinct("n").alias("sessions"), F.count(F.lit(1)).alias("events"))


@query(f"""WITH u AS (SELECT user_id, {r("avg((event_type = 'purchase')::INT)", 4)} AS ratio, count(*) AS n FROM events GROUP BY user_id) SELECT user_id, CASE WHEN n < 5 THEN 'new' WHEN ratio >= 0.25 AND ratio < 0.30 THEN 'latent' WHEN ratio < 0.25 THEN 'drain' ELSE 'active' END AS phase FROM u""")
def evidence_phase(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "events").groupBy("user_id").agg(T.round_to(F.avg((F.col("event_type") == "purchase").cast("int")), 4).alias("ratio"), F.count(F.lit(1)).alias("n"))
    return d.select("user_id", S.evidence_phase(F.col("n"), F.col("ratio")).alias("phase"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, p_brand AS brand, p_name AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R') SELECT l_orderkey, l_partkey, brand || ' ' || n AS pair FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, n) AS k FROM c) WHERE k <= 3""")
def training_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(query, cited record) pairs: the first three cited items of a session."""
    c = table(spark, sf, "lineitem").filter("l_returnflag <> 'R'").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    c = c.withColumn("k", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "p_name"))).filter("k <= 3")
    return c.select("l_orderkey", "l_partkey", F.concat_ws(" ", "p_brand", "p_name").alias("pair"))
