"""Clusters and communities of records: spherical k-means, tag graphs, merging of small groups, and their search."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import round_to
from ..functions.vectors import dot, normalised
from .graphs import undirected
from .retrieval import knn, pairs_sharing


def seeds_by_distance(vectors: DataFrame, k: int, key: str, vector: str = "v", sample_rows: int = 16_384, seed: int = 7) -> list[list[float]]:
    """``k`` starting points of k-means++ (by 1 - inner product) on a hash-drawn sample of about ``sample_rows`` rows, the same at every run."""
    n = vectors.count()
    share = min(1.0, sample_rows / max(1, n))
    drawn = vectors.filter(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < share * (1 << 30)).orderBy(key).select(vector).collect()
    x = np.array([r[0] for r in drawn], float)
    if len(x) <= k:
        return x.tolist()
    rng = np.random.default_rng(seed)
    picked = [int(rng.integers(len(x)))]
    far = 1 - x @ x[picked[0]]
    while len(picked) < k:
        weight = np.maximum(0, far)
        weight[picked] = 0
        picked.append(int(rng.choice(len(x), p=weight / weight.sum())) if weight.sum() else next(i for i in range(len(x)) if i not in picked))
        far = np.minimum(far, 1 - x @ x[picked[-1]])
    return x[picked].tolist()


def nearest_centroid(vector: Column, centroids: Sequence[Sequence[float]]) -> Column:
    """The index of the centroid with the largest inner product, the first among equals. Centroids are few and go into the plan."""
    points = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centroids])
    products = F.transform(points, lambda c: dot(vector, c))
    return (F.array_position(products, F.array_max(products)) - 1).cast("int")


def spherical_kmeans(vectors: DataFrame, key: str, seeds: Sequence[Sequence[float]], vector: str = "v", rounds: int = 10) -> tuple[DataFrame, list[list[float]]]:
    """((key, cluster), centroids): ``rounds`` times each vector joins its nearest centroid and each centroid becomes its members' normalised mean; without members it stays.

    Each round is one pass with partial sums of k rows; the last assignment is by the centroids before their last move. It stops early when none moves.
    ``vectors`` should be cached or written where reading them is dear.
    """
    centroids = [list(map(float, c)) for c in seeds]
    if not centroids:
        return vectors.select(key, F.lit(None).cast("int").alias("cluster")).limit(0), []
    d = range(len(centroids[0]))
    before = centroids
    for _ in range(rounds):
        before = centroids
        home = vectors.withColumn("_c", nearest_centroid(F.col(vector), centroids))
        means = home.groupBy("_c").agg(F.array(*[F.avg(F.get(F.col(vector), F.lit(i))) for i in d]).alias("_m")).select("_c", normalised(F.col("_m")).alias("_m"))
        moved = {r["_c"]: list(r["_m"]) for r in means.collect()}
        centroids = [moved.get(i, c) for i, c in enumerate(centroids)]
        if centroids == before:
            break
    return vectors.select(key, nearest_centroid(F.col(vector), before).alias("cluster")), centroids


def tag_graph(records: DataFrame, key: str, edges: DataFrame | None = None) -> DataFrame:
    """(a, b) with a < b: records that share two tags or more, or are joined by an edge (src, dst)."""
    both = pairs_sharing(records, key, 2).select("a", "b")
    if edges is None:
        return both
    own = records.select(F.col(key).alias("_id"), F.array_distinct("tags").alias("_t"))  # pairs are told apart already: only edges between records without two common tags are new
    e = undirected(edges, "src", "dst").join(own.toDF("a", "_x"), "a", "left").join(own.toDF("b", "_y"), "b", "left")
    return both.union(e.filter(F.coalesce(F.size(F.array_compact(F.array_intersect("_x", "_y"))) < 2, F.lit(True))).select("a", "b").distinct())


def merge_tiny(members: DataFrame, key: str, least: int = 4) -> DataFrame:
    """(key, community): members of communities under ``least`` go to the large one that has most of their tags, the smallest label among equals.

    ``members`` has (key, community, tags). A member that shares no tag goes to the smallest large label; without large communities nothing moves.
    Tags of large communities are those before the merge, so the order of members doesn't matter.
    """
    size = members.groupBy("community").agg(F.count(F.lit(1)).alias("_n"))
    d = members.join(size, "community")
    large, tiny = d.filter(F.col("_n") >= least), d.filter(F.col("_n") < least)
    has = large.select("community", F.explode("tags").alias("_tag")).distinct()
    shared = tiny.select(key, F.explode(F.array_distinct("tags")).alias("_tag")).join(has, "_tag").groupBy(key, "community").agg(F.count(F.lit(1)).alias("_k"))
    best = shared.groupBy(key).agg(F.max("_k").alias("_k")).join(shared, [key, "_k"]).groupBy(key).agg(F.min("community").alias("_to"))
    first = large.agg(F.min("community").alias("_first"))  # one row
    moved = tiny.select(key, "community").join(best, key, "left").join(F.broadcast(first)).select(key, F.coalesce("_to", "_first", "community").alias("community"))
    return large.select(key, "community").union(moved)


def search_communities(queries: DataFrame, communities: DataFrame, query: str = "query_id", most: int = 5, context: int = 2, least: float = 0.35) -> DataFrame:
    """(query, rank, community, similarity, in_context): the communities nearest to each query; the first ``context`` of them serve as context, if similar enough.

    ``queries`` has (query, q), ``communities`` (community, v).
    """
    d = knn(queries, communities, most, query, "community")
    return d.select(query, "rank", "community", F.col("score").alias("similarity"), ((F.col("rank") <= context) & (F.col("score") >= least)).alias("in_context"))


def described(members: DataFrame, group: str, order: str, title: str, most_tags: int = 6, most_titles: int = 5) -> DataFrame:
    """(group, summary): the label, the first distinct tags and titles in ``order``, and how many records more.

    Tags and titles are cut before they are gathered: a large group sends a few rows.
    """
    w = Window.partitionBy(group)
    tags = members.select(group, order, F.posexplode("tags").alias("_p", "_tag")).groupBy(group, "_tag").agg(F.min(F.struct(order, "_p")).alias("_at"))
    tags = tags.withColumn("_k", F.row_number().over(w.orderBy("_at"))).filter(F.col("_k") <= most_tags)
    tags = tags.groupBy(group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_k", "_tag"))), lambda x: x["_tag"]), ", ").alias("_tags"))
    heads = members.select(group, order, F.col(title).alias("_title")).withColumn("_k", F.row_number().over(w.orderBy(order))).filter(F.col("_k") <= most_titles)
    heads = heads.groupBy(group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_k", "_title"))), lambda x: x["_title"]), "; ").alias("_titles"))
    n = members.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    rest = F.when(F.col("_n") > most_titles, F.concat(F.lit(" (+ "), (F.col("_n") - most_titles).cast("string"), F.lit(" more)"))).otherwise("")
    d = n.join(heads, group).join(tags, group, "left")
    return d.select(group, F.concat(F.col(group), F.lit(": Antipatterns covering "), F.coalesce("_tags", F.lit("")), F.lit(". Examples: "), "_titles", rest, F.lit(".")).alias("summary"))


def conditional_clusters(together: DataFrame, frequent: int = 10, least: float = 0.6) -> DataFrame:
    """(a, b, together, jaccard, min_conditional, confidence), rounded to two places, of pairs seen ``frequent`` times or more whose rarer direction still has ``least``.

    ``together`` has (a, b, together, n_a, n_b).
    """
    t = F.col("together")
    j, c = t / (F.col("n_a") + F.col("n_b") - t), t / F.greatest("n_a", "n_b")
    d = together.filter(t >= frequent).withColumns({"_j": j, "_c": c}).filter(F.col("_c") >= least)
    return d.select("a", "b", "together", round_to(F.col("_j"), 2).alias("jaccard"), round_to(F.col("_c"), 2).alias("min_conditional"), round_to(0.5 * F.col("_j") + 0.5 * F.col("_c"), 2).alias("confidence"))


def strategy_labels(shares: DataFrame, n: int | Column) -> DataFrame:
    """(id, dominant, over, under) from (id, nash, actual) over ``n`` records: above three fair shares, above twice, and below 0.3 of, the equilibrium share (if that is over half a fair one)."""
    fair = 1 / (F.lit(n) if isinstance(n, int) else n)
    return shares.select("id", (F.col("nash") > 3 * fair).alias("dominant"), (F.col("actual") > 2 * F.col("nash")).alias("over"), ((F.col("actual") < 0.3 * F.col("nash")) & (F.col("nash") > 0.5 * fair)).alias("under"))
