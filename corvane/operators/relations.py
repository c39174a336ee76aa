"""Detectors of relationships between records, query expansion along them, and the stability of what is injected."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import retrieval as X

# Pairs of opposing words, in order.
OPPOSING = (("always ", "never "), ("use sync", "use async"), ("synchronous", "asynchronous"), ("mutable", "immutable"), ("eager", "lazy"), ("inline", "external"), ("class component", "function component"))
# Phrases that name a prerequisite, and phrases that name an earlier step.
REQUIRES = (
    r"(?i)(?:always|must|first)\s+(.{5,60}?)\s+before\s+(?:using|applying|running|creating|calling)",
    r"(?i)ensure\s+(.{5,60}?)\s+(?:exists?|is\s+(?:configured|set\s*up|running|ready))\s+(?:first|before)",
    r"(?i)(?:prerequisite|requires?)\s*:?\s+(.{5,80}?)(?:\.|,|$)",
)
PRECEDES = (r"(?i)after\s+(.{5,50}?)(?:[,;]\s*|\s+(?:always|then|you|make))", r"(?i)once\s+(.{5,50}?)\s+(?:is|are|has)\s+(?:complete|done|finished|ready)", r"(?i)following\s+(.{5,50}?)(?:[,;]|$)")
#: Types that proposed edges may have.
EDGE_TYPES = ("requires", "see_also", "co_inject", "escalates_to", "implies")


def titles(records: DataFrame, key: str, title: Column, *keep: str) -> DataFrame:
    """(key, [keep], token): the distinct tokens of titles."""
    return records.select(key, *keep, F.explode(F.array_distinct(T.tokens(title, T.STOP_RELATIONS))).alias("token"))


def title_pairs(records: DataFrame, key: str, title: Column, least: float = 0.3) -> DataFrame:
    """(a, b, shared, similarity) of records of one stack with similar titles."""
    c = title_classes(records, key, title)
    return X.members_paired(X.alike_classes(c, least, "stack"), c, "shared", "similarity")


def title_classes(records: DataFrame, key: str, title: Column, carry: Sequence[str] = ()) -> DataFrame:
    """``retrieval.classes_of`` the records of a stack by the tokens of their titles; titles without tokens are left out."""
    sets = X.token_sets(records, key, title, "stack", *carry, tokenizer=lambda t: T.tokens(t, T.STOP_RELATIONS)).filter(F.size("tokens") > 0)
    return X.classes_of(sets, key, F.col("tokens"), "stack", carry)


def _sides(pairs: DataFrame, records: DataFrame, key: str, *columns: str) -> DataFrame:
    """``pairs`` with the columns of both records, unless the pairs have them."""
    if all(f"{c}_{x}" in pairs.columns for c in columns for x in "ab"):
        return pairs
    side = lambda x: records.select(F.col(key).alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns])
    return pairs.join(side("a"), "a").join(side("b"), "b")


def supersedes(pairs: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """(newer, older, reason): one of two similar titles is deprecated, or names a version where the other names a range of them."""
    d = _sides(pairs, records, key, "deprecated", "framework_version")
    old = lambda x: F.coalesce(F.col(f"deprecated_{x}"), F.lit(False))
    ranged = lambda x: F.col(f"framework_version_{x}").rlike(">")
    flags = F.when(F.col("similarity") > 0.35, F.when(old("a") & ~old("b"), F.struct(F.col("b").alias("newer"), F.col("a").alias("older"), F.lit("deprecated").alias("reason"))).when(old("b") & ~old("a"), F.struct(F.col("a").alias("newer"), F.col("b").alias("older"), F.lit("deprecated").alias("reason"))))
    versions = F.when(F.col("similarity") > 0.55, F.when(ranged("a") & ~ranged("b"), F.struct(F.col("a").alias("newer"), F.col("b").alias("older"), F.lit("range").alias("reason"))).when(ranged("b") & ~ranged("a"), F.struct(F.col("b").alias("newer"), F.col("a").alias("older"), F.lit("range").alias("reason"))))
    return d.select(F.explode(F.array_compact(F.array(flags, versions))).alias("e")).select("e.*")


def opposing_sides(content: Column, opposing: Sequence[tuple[str, str]] = OPPOSING) -> Column:
    """Which sides of the opposing pairs a text holds, two bits for each pair."""
    low = F.lower(content)
    return sum((F.coalesce(F.contains(low, F.lit(w)), F.lit(False)).cast("bigint") * (1 << (2 * i + k)) for i, pair in enumerate(opposing) for k, w in enumerate(pair)), F.lit(0).cast("bigint"))


def conflicts(pairs: DataFrame, records: DataFrame, key: str, content: str, opposing: Sequence[tuple[str, str]] = OPPOSING) -> DataFrame:
    """(a, b, rule): similar titles whose contents hold the two sides of an opposing pair; ``rule`` is the first such pair, from 1."""
    d = _sides(pairs, records.withColumn("sides", opposing_sides(F.col(content), opposing)), key, "sides")
    has = lambda x, bit: F.col(f"sides_{x}").bitwiseAND(1 << bit) != 0
    rule = F.coalesce(*[F.when((has("a", 2 * i) & has("b", 2 * i + 1)) | (has("a", 2 * i + 1) & has("b", 2 * i)), i + 1) for i in range(len(opposing))])
    return d.select("a", "b", rule.alias("rule")).filter("rule is not null")


def phrase_edges(records: DataFrame, key: str, text: Column, title: Column, patterns: Sequence[str], least: float, save: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """(src, dst, pattern, overlap, n): for each pattern's first phrase in a record, the first other record of the stack whose title has at least two, and ``least``, of its tokens.

    Equal phrases of a stack are one, as are equal titles, and a phrase looks for its rarest tokens only, as many as leave it too few. Tokens are told apart by 64-bit hashes.
    """
    words = lambda t: F.array_sort(F.transform(F.array_distinct(T.tokens(t, T.STOP_RELATIONS)), lambda x: F.xxhash64(x)))
    found = F.array(*[F.struct(F.lit(i).alias("pattern"), words(F.regexp_extract(text, p, 1)).alias("tokens")) for i, p in enumerate(patterns, 1)])
    said = records.filter("stack is not null").select(F.col(key).alias("src"), "stack", F.explode(found).alias("p")).select("src", "stack", "p.pattern", "p.tokens").filter(F.size("tokens") >= 2)
    said, titled = save(said.withColumn("phrase", F.xxhash64("stack", "tokens"))), save(title_classes(records, key, title))
    # of a class of equal titles only the two smallest ids can be the first other record
    ids = titled.filter("tile = 0").select("cls", F.explode(F.slice(F.array_sort("entries.key"), 1, 2)).alias("dst"))
    one = titled.filter("tile = 0").select("cls", "stack", F.col("set").alias("title"), F.explode("set").alias("token"))
    df = one.groupBy("stack", "token").agg(F.count(F.lit(1)).alias("df"))
    p = said.select("phrase", "stack", "tokens").dropDuplicates(["phrase"])
    order = p.select("phrase", "stack", F.explode("tokens").alias("token")).join(df, ["stack", "token"], "left").groupBy("phrase", "stack").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token"))).getField("token").alias("tokens"))
    n = F.size("tokens")
    need = F.greatest(F.lit(2), F.ceil(n * least - 1e-9).cast("int"))  # so one of the rarest n - need + 1 tokens is common
    heads = order.select("phrase", "stack", "tokens", F.explode(F.slice("tokens", F.lit(1), n - need + 1)).alias("token"))
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    common = F.array_intersect("tokens", "title")
    hits = heads.repartition(parts, "stack", "token").join(one, ["stack", "token"]).withColumn("_common", common).filter(F.get("_common", F.lit(0)) == F.col("token"))  # once: at the first token in common
    hits = hits.select("phrase", "cls", F.size("_common").cast("bigint").alias("overlap"), n.alias("n")).filter((F.col("overlap") >= 2) & (F.col("overlap") / F.col("n") >= least))
    near = hits.join(ids, "cls").withColumn("_k", F.row_number().over(Window.partitionBy("phrase").orderBy("dst"))).filter("_k <= 2").select("phrase", "dst", "overlap", "n")
    best = said.join(near, "phrase").filter("src <> dst").groupBy("src", "pattern").agg(F.min(F.struct("dst", "overlap", "n")).alias("e"))
    return best.select("src", "e.dst", "pattern", "e.overlap", "e.n")


def valid_proposals(proposals: DataFrame, records: DataFrame, edges: DataFrame, key: str, rank: Column, least: float = 0.75) -> DataFrame:
    """Proposed edges (src, dst, type, confidence) between known, different records, confident enough, of a known type, not there in either direction; escalations lead upwards in ``rank``."""
    known = records.select(F.col(key).alias("_id"), rank.alias("_rank"))
    d = proposals.filter((F.col("src") != F.col("dst")) & (F.col("confidence") >= least) & F.col("type").isin(*EDGE_TYPES))
    d = d.join(known.toDF("src", "_from"), "src").join(known.toDF("dst", "_to"), "dst").filter((F.col("type") != "escalates_to") | (F.col("_from") < F.col("_to")))
    there = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    return d.join(there, ["src", "dst"], "left_anti").select("src", "dst", "type", F.floor(F.col("confidence") * 100 + 0.5).cast("double").alias("_c")).withColumn("confidence", F.col("_c") / 100).drop("_c")


def graph_novel(query_tokens: DataFrame, doc_tokens: DataFrame, edges: DataFrame, n: int | Column, query: str, doc: str, most: int = 6, common: float = 0.3) -> DataFrame:
    """(query, token, place): tokens of the neighbours of the three records that share most tokens with a query.

    ``doc_tokens`` has (doc, token, at), ``at`` the place of the token's first occurrence. Tokens of the query or of more than a share ``common`` of
    all records are left out; the first ``most`` count, by rank of the hit, ordinal of the neighbour (at most five, see_also before implies) and place.
    """
    hits = query_tokens.join(doc_tokens.select(doc, "token"), "token").groupBy(query, doc).agg(F.count(F.lit(1)).alias("hits"))
    near = X.neighbours_of_hits(X.top(hits, [query], [F.desc("hits"), doc], 3), edges, query, doc)
    df = X.document_frequency(doc_tokens.select("token"))
    t = near.join(doc_tokens.withColumnRenamed(doc, "neighbour"), "neighbour").join(query_tokens, [query, "token"], "left_anti")
    t = t.join(df.filter(F.col("df") <= F.lit(common) * n), "token").groupBy(query, "token").agg(F.min(F.struct("hit_rank", "ordinal", "at")).alias("_place"))
    return X.top(t, [query], ["_place", "token"], most, "place").select(query, "token", "place")


def synonym_novel(query_tokens: DataFrame, postings: DataFrame, synonyms: DataFrame, query: str, most: int = 6) -> DataFrame:
    """(query, token, place): synonyms of a query's tokens in its likely stack, that with the most postings of them (ties to the smaller name).

    ``query_tokens`` has (query, token, at); the first ``most`` new ones count, by place of the token and rank of the synonym.
    """
    votes = query_tokens.join(postings, "token").groupBy(query, "stack").agg(F.count(F.lit(1)).alias("votes"))
    stack = X.top(votes, [query], [F.desc("votes"), "stack"], 1).select(query, "stack")
    s = query_tokens.join(stack, query).join(synonyms.withColumnRenamed("term", "token"), ["stack", "token"])
    s = s.select(query, F.col("synonym").alias("token"), "at", "rank").join(query_tokens.select(query, "token"), [query, "token"], "left_anti")
    s = s.groupBy(query, "token").agg(F.min(F.struct("at", "rank")).alias("_place"))
    return X.top(s, [query], ["_place", "token"], most, "place").select(query, "token", "place")


def expanded(query_tokens: DataFrame, doc_tokens: DataFrame, edges: DataFrame, n: int | Column, postings: DataFrame, synonyms: DataFrame, query: str, doc: str, most: int = 12) -> DataFrame:
    """(query, token, place, origin): at most ``most`` new tokens of each query, half of them from the graph (``graph_novel``), then half from synonyms (``synonym_novel``).

    Half is rounded up. Synonyms are looked for behind the query's own tokens and those that the graph gave, in this order, and both have a vote in the query's likely stack. ``query_tokens`` is (query, token, at).
    """
    half = -(-most // 2)
    graph = graph_novel(query_tokens.select(query, "token"), doc_tokens, edges, n, query, doc, half)
    last = query_tokens.groupBy(query).agg(F.max("at").alias("_last"))
    both = query_tokens.select(query, "token", "at").unionAll(graph.join(last, query).select(query, "token", (F.col("_last") + F.col("place")).alias("at")))
    found = synonym_novel(both, postings, synonyms, query, half)
    return graph.withColumn("origin", F.lit("graph")).unionAll(found.withColumn("origin", F.lit("synonym")))


def systematic(records: DataFrame, group: str, order: str, samples: int) -> DataFrame:
    """Every floor(n / samples)-th record of a group, at most ``samples``; all, if there are no more."""
    w = Window.partitionBy(group)
    d = records.withColumns({"_n": F.count(F.lit(1)).over(w), "_at": F.row_number().over(w.orderBy(order)) - 1})
    step = F.when(F.col("_n") <= samples, 1).otherwise(F.floor(F.col("_n") / samples))
    return d.filter((F.col("_at") % step == 0) & (F.floor(F.col("_at") / step) < samples)).drop("_n", "_at")


def injection_sets(queries: DataFrame, postings: DataFrame, query: str, doc: str, most: int = 5) -> DataFrame:
    """(query, ids): the records with the largest sums of ln((N + 1) / (df + 0.5)) over a query's tokens; N counts all postings."""
    df = X.document_frequency(postings)
    n = postings.agg(F.count(F.lit(1)).alias("_N"))
    w = queries.join(df, "token").join(F.broadcast(n)).withColumn("w", F.log((F.col("_N") + 1) / (F.col("df") + 0.5)))
    s = w.join(postings, "token").groupBy(query, doc).agg(T.round_to(F.sum("w"), 6).alias("score"))
    return X.top(s, [query], [F.desc("score"), doc], most).groupBy(query).agg(F.collect_list(doc).alias("ids"))


def stability(records: DataFrame, postings: DataFrame, key: str, group: str, tokens: Column, samples: int = 20, longest: int = 8, drops: int = 3) -> DataFrame:
    """(group, lambda, stddev, samples): how much a group's injection sets change when a token is dropped from the query.

    A record's first ``longest`` tokens are a query; each of the first ``drops`` is left out once. The logarithm of the ids in only one of the two sets
    over the size of the first is averaged.
    """
    q = records.withColumn("_tokens", F.slice(tokens, 1, longest)).filter(F.size("_tokens") >= 2)
    q = systematic(q.select(key, group, "_tokens"), group, key, samples)
    ways = F.sequence(F.lit(0), F.least(F.lit(drops), F.size("_tokens")))
    q = q.select(key, group, F.explode(ways).alias("_drop"), "_tokens").withColumn("_q", F.struct(key, "_drop"))
    t = q.select("_q", F.posexplode("_tokens").alias("_p", "token"), "_drop").filter("_p + 1 <> _drop").select("_q", "token").distinct()
    sets = injection_sets(t, postings, "_q", "_id")
    whole = sets.filter("_q._drop = 0").select(F.col(f"_q.{key}").alias(key), F.col("ids").alias("_whole"))
    less = q.filter("_drop > 0").join(sets, "_q", "left").join(whole, key).select(group, "_whole", F.coalesce("ids", F.expr("cast(array() as array<bigint>)")).alias("_less"))
    moved = F.size(F.array_except("_whole", "_less")) + F.size(F.array_except("_less", "_whole"))
    x = less.select(group, F.log(F.greatest(moved, F.lit(0.1)) / F.greatest(F.size("_whole"), F.lit(1))).alias("x"))
    return x.groupBy(group).agg(T.round_to(F.avg("x"), 3).alias("lambda"), T.round_to(F.stddev_pop("x"), 3).alias("stddev"), F.count(F.lit(1)).alias("samples"))
