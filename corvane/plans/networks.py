"""Queries over the graph of similar titles: forests, cliques, propagation, and rounds of sparse products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cliques, spectral, twins
from ..operators import relations as L
from ..sources.scratch import saved
from . import relations as R
from .base import query, r, records


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Links and members (see ``operators.twins``) of records with similar titles, written once."""
    c = saved(L.title_classes(R._titled(spark, sf), "doc_id", F.col("title")))
    links = saved(twins.links(c, 0.3, "stack"))
    return links, saved(twins.members(c, links))


FOREST = f"""{R.PAIRS}, t AS (SELECT (1 - i / 19.0::DOUBLE) AS th, i FROM range(0, 20) r(i)), n AS (SELECT a AS v FROM tp UNION SELECT b FROM tp), k AS (SELECT i, a, b FROM tp, t WHERE s >= th - 1e-12),
    reach AS (SELECT i, v, v AS u FROM n, t UNION SELECT r.i, r.v, CASE WHEN k.a = r.u THEN k.b ELSE k.a END FROM reach r JOIN k ON k.i = r.i AND (k.a = r.u OR k.b = r.u)),
    b AS (SELECT i, count(DISTINCT m) AS b0 FROM (SELECT i, v, min(u) AS m FROM reach GROUP BY ALL) GROUP BY i), e AS (SELECT i, count(*) AS e FROM k GROUP BY i)"""


@query(f"""WITH RECURSIVE {FOREST} SELECT {r('th', 4)} AS threshold, coalesce(e, 0) AS edges, b0, coalesce(e, 0) - (SELECT count(*) FROM n) + b0 AS b1 FROM t JOIN b USING (i) LEFT JOIN e USING (i)""")
def filtration_trace(spark: SparkSession, sf: str) -> DataFrame:
    """Edges, components and cycles at twenty thresholds of title similarity."""
    links, members = _graph(spark, sf)
    return twins.filtration(links, members, twins.spanning_forest(links, members, saved)).withColumn("threshold", T.round_to(F.col("threshold"), 4))


# the edge joins two components of what is kept before it: the order is the forest's
KRUSKAL = f"""WITH RECURSIVE {R.PAIRS}, o AS (SELECT *, row_number() OVER (ORDER BY s DESC, a, b) AS k FROM tp), reach AS (SELECT k, a AS v, a AS u FROM o UNION SELECT r.k, r.v, CASE WHEN x.a = r.u THEN x.b ELSE x.a END FROM reach r JOIN o x ON x.k < r.k AND (x.a = r.u OR x.b = r.u))"""


@query(f"""{KRUSKAL} SELECT a, b, {r('s')} AS confidence FROM o WHERE NOT EXISTS (SELECT 1 FROM reach WHERE reach.k = o.k AND reach.u = o.b)""")
def spanning_forest(spark: SparkSession, sf: str) -> DataFrame:
    return twins.spanning_forest(*_graph(spark, sf), saved).select("a", "b", T.round_to(F.col("confidence"), 6).alias("confidence"))


@query(f"""WITH RECURSIVE {R.PAIRS}, g AS (SELECT a AS i, b AS j FROM tp UNION ALL SELECT b, a FROM tp), adj AS (SELECT i, list(j) AS l FROM g GROUP BY i),
    c AS (SELECT [a, b] AS nodes FROM tp UNION ALL SELECT list_append(c.nodes, g.j) FROM c JOIN g ON g.i = c.nodes[1] AND g.j > c.nodes[-1] JOIN adj ON adj.i = g.j WHERE list_has_all(adj.l, c.nodes)),
    m AS (SELECT nodes FROM c WHERE len(nodes) >= 3 AND NOT EXISTS (SELECT 1 FROM adj WHERE list_has_all(adj.l, c.nodes)))
    SELECT array_to_string(nodes, ',') AS nodes, len(nodes)::INT AS size, {r('avg(s)')} AS confidence FROM m JOIN tp ON list_contains(nodes, a) AND list_contains(nodes, b) GROUP BY nodes""")
def title_cliques(spark: SparkSession, sf: str) -> DataFrame:
    """Maximal cliques of three records or more with similar titles, and their mean similarity."""
    d = cliques.cliques(*_graph(spark, sf), save=saved)
    return d.select(F.array_join(F.transform("nodes", lambda x: x.cast("string")), ",").alias("nodes"), "size", T.round_to(F.col("confidence"), 6).alias("confidence"))


def _propagated(rounds: int) -> str:
    out = f"{R.PAIRS}, g AS (SELECT a AS i, b AS j FROM tp UNION ALL SELECT b, a FROM tp), l0 AS (SELECT DISTINCT i AS node, i AS label FROM g)"
    for k in range(1, rounds + 1):
        out += f", l{k} AS (SELECT i AS node, arg_min(label, (-n, label)) AS label FROM (SELECT i, label, count(*) AS n FROM g JOIN l{k - 1} ON j = node GROUP BY ALL) GROUP BY i)"
    return out


@query(f"WITH {_propagated(5)} SELECT node, label FROM l5")
def label_communities(spark: SparkSession, sf: str) -> DataFrame:
    """Communities after five rounds of label propagation."""
    return twins.label_propagation(*_graph(spark, sf), saved, rounds=5)


def _rounds(rounds: int) -> str:
    out = f"""{R.PAIRS}, m AS (SELECT a AS i, b AS j, s AS w FROM tp UNION ALL SELECT b, a, s FROM tp), d AS (SELECT i AS node, sum(w) AS degree FROM m GROUP BY i), k AS (SELECT avg(degree) AS shift FROM d),
    s0 AS (SELECT node, degree, sin(node + 1) AS x FROM d), v0 AS (SELECT node, degree, (x - (SELECT avg(x) FROM s0)) / (SELECT sqrt(sum(x * x)) FROM s0) AS x FROM s0)"""
    for i in range(1, rounds + 1):
        out += f""", a{i} AS (SELECT i, sum(w * x) AS ax FROM m JOIN v{i - 1} ON j = node GROUP BY i), s{i} AS (SELECT node, degree, shift * x - (degree * x - ax) AS x FROM v{i - 1} JOIN a{i} ON i = node, k),
    v{i} AS (SELECT node, degree, (x - (SELECT avg(x) FROM s{i})) / (SELECT sqrt(sum((x - (SELECT avg(x) FROM s{i})) ** 2)) FROM s{i}) AS x FROM s{i})"""
    return out + f", z AS (SELECT i, sum(w * x) AS ax FROM m JOIN v{rounds} ON j = node GROUP BY i), gap AS (SELECT sum(x * (degree * x - ax)) AS gap FROM v{rounds} JOIN z ON i = node)"


@query(f"WITH {_rounds(4)} SELECT node, {r('x')} AS x, {r('gap')} AS gap FROM v4, gap")
def fiedler_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Four rounds of the power iteration, from sin(node + 1)."""
    links, members = _graph(spark, sf)
    v, gap = spectral.fiedler_rounds(links.withColumnRenamed("confidence", "w"), saved, F.sin(F.col("node") + 1), rounds=4, twins=members)
    return v.select("node", T.round_to(F.col("x"), 6).alias("x"), T.round_to(F.lit(gap), 6).alias("gap"))


def _played(rounds: int) -> str:
    out = f"{R.PAIRS}, m AS (SELECT a AS i, b AS j, s * 0.3 AS w FROM tp UNION ALL SELECT b, a, s * 0.3 FROM tp), c AS (SELECT doc_id AS node, coalesce(confidence, 0.5)::DOUBLE AS c FROM rec), f0 AS (SELECT node, c, c / (SELECT sum(c) FROM c) AS f FROM c)"
    for i in range(1, rounds + 1):
        out += f""", l{i} AS (SELECT i, sum(w * f) AS lost FROM m JOIN f{i - 1} ON j = node GROUP BY i), p{i} AS (SELECT node, c, f, greatest(0, c - coalesce(lost, 0)) AS pay FROM f{i - 1} LEFT JOIN l{i} ON i = node),
    f{i} AS (SELECT node, c, f + (pay / (SELECT sum(pay) FROM p{i}) - f) / {i + 1}.0::DOUBLE AS f FROM p{i})"""
    return out


@query(f"WITH {_played(4)} SELECT node, {r('f', 9)} AS share FROM f4")
def best_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Four rounds of fictitious play of all records along similar titles."""
    conf = records(spark, sf).select(F.col("doc_id").alias("node"), "confidence")
    links, members = _graph(spark, sf)
    d = spectral.best_responses(conf, links.withColumnRenamed("confidence", "w"), saved, rounds=4, least=0.0, twins=members)
    return d.select("node", T.round_to(F.col("share"), 9).alias("share"))
