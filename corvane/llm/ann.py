"""Approximate nearest neighbours over balanced posting lists.

Vectors near a boundary are replicated to several clusters; a query finds clusters through a graph over the
centroids that is searched in memory, and a ratio of distances tells which lists it reads. The ratio is
chosen by the recall of a bounded set of queries, measured against brute force over the whole index.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal, materialize


@dataclass
class Lists:
    """Centroids (of vectors made equally long by one more component), and a graph of their neighbours."""

    centroids: np.ndarray
    neighbours: np.ndarray
    longest: float  # of the squared norms, of scaled vectors
    scale: float = 1.0  # vectors are divided by this, which is a power of two, so that squares neither overflow nor vanish
    floor: float = 0.0  # the mean distance of queries to their nearest centroid; a query that is nearer counts as so far

    def augment(self, x: np.ndarray) -> np.ndarray:
        """With sqrt(longest - |x|^2) appended, the largest inner product is the smallest distance."""
        x = x / self.scale
        rest = np.maximum(0, self.longest - (x * x).sum(1))
        return np.concatenate([x, np.sqrt(rest)[:, None]], 1)

    def asked(self, q: np.ndarray) -> np.ndarray:
        """Queries get a zero for the component that vectors get."""
        return np.concatenate([q / self.scale, np.zeros((len(q), 1))], 1)

    def search(self, q: np.ndarray, ratio: float, sizes: np.ndarray, least: int) -> list[int]:
        """Lists in order of distance, as far as ``ratio`` times the nearest one's (or ``floor``), and on until they hold ``least`` entries.

        Best-first search over the graph: the nearest open centroid is read and its neighbours are opened.
        """
        seen = np.zeros(len(self.centroids), bool)
        entry = np.unique(np.linspace(0, len(self.centroids) - 1, min(16, len(self.centroids))).astype(int))
        heap: list[tuple[float, int]] = []

        def visit(nodes: np.ndarray) -> None:
            nodes = nodes[~seen[nodes]]
            seen[nodes] = True
            d = self.centroids[nodes] - q
            for x in zip(np.sqrt((d * d).sum(1)).tolist(), nodes.tolist(), strict=True):
                heapq.heappush(heap, x)

        visit(entry)
        best, found, held, spare = np.inf, [], 0, 0
        while heap:
            d, node = heapq.heappop(heap)
            if d > ratio * max(best, self.floor) and held >= least:
                spare += 1
                if spare > 8:  # a few more are opened, for what lies behind them
                    break
            else:
                found.append((d, node))
                held += int(sizes[node])
            if d < best:
                best = d
            visit(self.neighbours[node])
        found.sort()
        out, held = [], 0
        for d, node in found:
            if d <= ratio * max(found[0][0], self.floor) or held < least:
                out.append(node)
                held += int(sizes[node])
        return out


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * (x @ c.T)))


def fit_lists(sample: np.ndarray, lists: int, longest: float, scale: float = 1.0, degree: int = 24, rounds: int = 10, seed: int = 3) -> Lists:
    """Balanced k-means on ``sample``: after each round, clusters above twice the mean size give half of themselves to the smallest ones. ``longest`` is that of all vectors."""
    x = Lists(sample, np.zeros((0, 0), int), longest, scale).augment(sample)
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(x)))
    c = x[np.sort(rng.choice(len(x), lists, replace=False))].copy()
    for _ in range(rounds):
        home = np.concatenate([_distances(x[i : i + 8192], c).argmin(1) for i in range(0, len(x), 8192)])
        order = np.argsort(home, kind="stable")
        sizes = np.bincount(home, minlength=lists)
        full = np.flatnonzero(sizes)
        c[full] = np.add.reduceat(x[order], (np.cumsum(sizes) - sizes)[full]) / sizes[full, None]
        small = np.argsort(sizes, kind="stable").tolist()
        for big in np.flatnonzero(sizes > 2 * len(x) / lists).tolist():
            give = small.pop(0)
            if sizes[give] * 4 >= sizes[big] or give == big:
                break
            members = x[home == big]
            c[give] = members[rng.integers(len(members))]
    d = _distances(c, c)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, 1, kind="stable")[:, : max(1, min(degree, lists - 1))] if lists > 1 else np.zeros((1, 1), int)
    links = [set(r) for r in near.tolist()]
    for i, row in enumerate(near.tolist()):
        for j in row[: degree // 3]:
            links[j].add(i)
    reached = np.zeros(lists, bool)  # every centroid can be reached from the first
    while not reached.all():
        todo = [0] if not reached[0] else [int(np.flatnonzero(~reached)[0])]
        if reached[0]:
            to = todo[0]
            links[int(np.where(reached, d[to], np.inf).argmin())].add(to)
        while todo:
            i = todo.pop()
            if not reached[i]:
                reached[i] = True
                todo += links[i]
    width = max(map(len, links))
    graph = np.array([[*r, *([i] * (width - len(r)))] for i, r in enumerate(map(sorted, links))])
    return Lists(c, graph, longest, scale)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision; one that isn't a number (infinite terms of both signs) counts as the least."""
    with np.errstate(over="ignore", invalid="ignore"):
        s = (q * x).sum(-1)
    return np.where(np.isnan(s), -np.inf, s)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All inner products of rows of ``q`` and ``x``, to within ``slack`` of the exact ones."""
    with np.errstate(over="ignore", invalid="ignore"):
        s = q @ x.T
    return np.where(np.isnan(s), -np.inf, s)


def slack(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Twice the most by which two ways to sum a row's products can differ, by the largest components; infinite where products overflow."""
    most = np.abs(q).max(1) * (np.abs(x).max() if x.size else 0.0) if q.size else np.zeros(len(q))
    with np.errstate(over="ignore"):
        return np.nan_to_num(most * q.shape[1] ** 2, nan=np.inf, posinf=np.inf) * 1e-15


def exact_neighbours(base: DataFrame, asked: Sequence[tuple[int, Sequence[float]]], k: int) -> dict[int, list[int]]:
    """The ids of the ``k`` best rows of ``base(vec_id, v)`` for each (id, vector) asked, by brute force; a task returns k rows for each."""
    ids, q = np.array([i for i, _ in asked]), np.array([v for _, v in asked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x, own = _rows(part, 1), part.column(0).to_numpy()
                s = products(q, x)
                s[ids[:, None] == own] = -np.inf
                least = np.partition(s, -k, 1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
                least -= slack(q, x)
                for i in range(len(ids)):
                    near = np.flatnonzero((s[i] >= least[i]) & (s[i] > -np.inf))
                    found = np.concatenate([best[i][0], own[near]]), np.concatenate([best[i][1], exact(q[i], x[near])])
                    top = np.lexsort((found[0], -found[1]))[:k]
                    best[i] = found[0][top], found[1][top]
        yield pa.record_batch([pa.array(np.repeat(ids, [len(b[0]) for b in best])), pa.array(np.concatenate([b[0] for b in best])), pa.array(np.concatenate([b[1] for b in best]))], names=["query_id", "vec_id", "score"])

    d = base.select("vec_id", "v").mapInArrow(frugal(run), "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out: dict[int, list[int]] = {}
    for i, v in d.withColumn("_rank", rank).filter(F.col("_rank") <= k).select("query_id", "vec_id").collect():
        out.setdefault(i, []).append(v)
    return out


def least_ratio(index: Lists, queries: np.ndarray, wanted: Sequence[Sequence[set[int]]], recall: float, ratio: float, sizes: np.ndarray, least: int) -> float:
    """The ratio, ``ratio`` at least, at which ``index.search`` finds ``recall`` of ``wanted``: for each query, the lists that hold each true neighbour.

    It starts where distances to all centroids say that the lists are near enough and grows while the search, which sees the
    graph only, finds less. From the largest quotient of distances on, every list is read.
    """
    d = _distances(queries, index.centroids)
    index.floor = float(d.min(1).mean())
    nearest = np.maximum(d.min(1), max(index.floor, 1e-12))
    need = np.sort([min(d[i, c] for c in lists) / nearest[i] for i, each in enumerate(wanted) for lists in each])
    last = float((d.max(1) / nearest).max())
    ratio, grow = max(ratio, float(need[int(np.ceil(recall * len(need))) - 1])), 1.01
    while ratio <= last:
        hits = 0
        for x, each in zip(queries, wanted, strict=True):
            read = set(index.search(x, ratio, sizes, least))
            hits += sum(not read.isdisjoint(lists) for lists in each)
        if hits >= recall * len(need):
            break
        ratio, grow = ratio * grow, grow**1.2
    return ratio


def usable(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors in double precision that take part: not null, no null or non-finite component, not zero, of the most common length."""
    d = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    d = d.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.exists("v", lambda x: x != 0))
    length = d.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return d.filter(F.size("v") == (length[0] if length else 0))


def _rows(batch: pa.RecordBatch, column: int) -> np.ndarray:
    values = batch.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def nearest_neighbours(
    table: DataFrame, k: int = 20, every: int = 20, ratio: float = 1.15, margin: float = 0.05, copies: int = 4, list_rows: int = 128, most_lists: int = 4096, sample_rows: int = 65_536, group_rows: int = 16_384, vector: str = "embedding", recall: float = 0.95, tried: int = 256
) -> DataFrame:
    """The ``k`` nearest vectors, by inner product, of every vector whose id is divisible by ``every``.

    Centroids are fitted on about ``sample_rows`` distinct vectors; there are at most ``most_lists`` of them, so that they and
    their graph stay within some MB in every task. Every vector is indexed, in each of up to ``copies`` lists whose centroid is
    at most ``1 + margin`` times as far as the nearest one. A query reads lists up to a ratio times as far as its nearest, and more until
    they hold 4 (k + 1) entries. The ratio is ``ratio``, or as much larger as it must be for about ``tried`` queries, drawn by a hash of their ids, to
    find ``recall`` of their neighbours by brute force over all vectors: a fixed ratio would find fewer the larger the table. Lists have no cap: they are dealt over groups of about ``group_rows`` entries, and long ones over several groups.
    Equal vectors are ordered by id and the first k + 1 can be results; the others, which can't, are left out before lists are made.

    A group's entries are held by one task while all queries that read it pass by, so nothing is copied for them.

    Vectors that are null, zero, or hold a null or non-finite component, or are not of the most common length, take no part. Very large components
    are scaled down to find lists; scores are those of the original vectors, where a product that overflows is infinite and one that isn't a number counts as minus infinity. Rows
    with the same id and vector count once; rows with the query's id are never its results. Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id. No rows if fewer than two vectors take part.
    """
    spark = table.sparkSession
    vectors = materialize(usable(table, vector), "vectors")
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    base = materialize(vectors.dropDuplicates(["vec_id", "v"]).withColumn("_copy", first).filter(F.col("_copy") <= k + 1), "distinct")
    rows = base.filter("_copy = 1").count()
    n_queries = vectors.filter(F.pmod("vec_id", F.lit(every)) == 0).count()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not rows or not n_queries:
        return spark.createDataFrame([], schema)
    share = min(1.0, sample_rows / rows)
    drawn = base.filter((F.col("_copy") == 1) & (F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(1 << 30)) < share * (1 << 30))).select("vec_id", "v").toPandas().sort_values("vec_id")
    sample = np.stack(drawn.v.to_numpy() if len(drawn) else [np.array(base.first()["v"])])
    largest = base.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
    scale = float(np.ldexp(1.0, int(np.frexp(largest)[1])))
    longest = base.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / scale) * (x / scale)))).first()[0]
    index = fit_lists(sample, min(most_lists, -(-rows // list_rows) if rows > list_rows else 1 + rows // 32), longest, scale)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                d = _distances(index.augment(_rows(part, 1)), index.centroids)
                some = min(copies, d.shape[1])
                near = np.argpartition(d, some - 1, 1)[:, :some]
                dist = np.take_along_axis(d, near, 1)
                row, col = np.nonzero(dist <= (1 + margin) * dist.min(1, keepdims=True))
                yield pa.record_batch([pa.array(near[row, col].astype(np.int64)), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row))], names=["list", "vec_id", "v"])

    posted = materialize(base.select("vec_id", "v").mapInArrow(frugal(assign), "list bigint, vec_id bigint, v array<double>"), "lists")
    counts = dict(posted.groupBy("list").count().collect())
    sizes = np.array([counts.get(i, 0) for i in range(len(index.centroids))])
    blocks = np.maximum(1, -(-sizes // group_rows))
    home, at, room = np.zeros(len(sizes), np.int64), 0, group_rows
    for i, (size, many) in enumerate(zip(sizes.tolist(), blocks.tolist(), strict=True)):
        if size > room or many > 1:
            at, room = at + 1, group_rows
        home[i] = at
        room -= size
        if many > 1:
            at, room = at + many, group_rows
    queries = vectors.filter(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "v")
    drawn_share = min(1.0, tried / n_queries)
    trial = [(r[0], r[1]) for r in queries.filter(F.pmod(F.xxhash64("vec_id", F.lit(13)), F.lit(1 << 30)) < drawn_share * (1 << 30)).collect()]
    trial = sorted(dict(sorted(trial or [tuple(queries.orderBy("vec_id").first())])).items())
    truth = exact_neighbours(base, trial, k)
    held: dict[int, set[int]] = {}
    wanted_ids = spark.createDataFrame([(v,) for v in sorted({v for vs in truth.values() for v in vs})], "vec_id bigint")
    for i, v in posted.join(F.broadcast(wanted_ids), "vec_id").select("vec_id", "list").collect():
        held.setdefault(i, set()).add(v)
    trial = [(i, v) for i, v in trial if i in truth]
    if trial:
        x = np.array([v for _, v in trial])
        ratio = least_ratio(index, index.asked(x), [[held[v] for v in truth[i]] for i, _ in trial], recall, ratio, sizes, 4 * (k + 1))
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _rows(batch, 1) if batch.num_rows else np.zeros((0, 1))
            out: list[list] = [[], [], []]
            for i, x in enumerate(index.asked(q)):
                groups: dict[int, list[int]] = {}
                for c in index.search(x, ratio, sizes, 4 * (k + 1)):
                    for b in range(int(blocks[c])):
                        groups.setdefault(int(home[c]) + b, []).append(c)
                for g, cs in groups.items():
                    for o, v in zip(out, (g, cs, i), strict=True):
                        o.append(v)
            yield pa.record_batch([pa.array(out[0], pa.int64()), batch.column(0).take(pa.array(out[2], pa.int64())), batch.column(1).take(pa.array(out[2], pa.int64())), pa.array(out[1], pa.list_(pa.int64()))], names=["group", "query_id", "q", "lists"])

    asked = queries.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "vec_id")
    asked = asked.mapInArrow(frugal(probe), "group bigint, query_id bigint, q array<double>, lists array<bigint>")
    asked = asked.select("group", F.lit(1).alias("side"), "query_id", "q", "lists")
    home_of = F.array(*[F.lit(int(x)) for x in home])
    blocks_of = F.array(*[F.lit(int(x)) for x in blocks])
    group = F.get(home_of, F.col("list").cast("int")) + F.pmod(F.xxhash64("vec_id"), F.get(blocks_of, F.col("list").cast("int")).cast("bigint"))
    stored = posted.select(group.cast("bigint").alias("group"), F.lit(0).alias("side"), "vec_id", "v", F.array("list"))

    def score(lists: np.ndarray, ids: np.ndarray, x: np.ndarray, part: pa.RecordBatch) -> pa.RecordBatch:
        """The best of one group's entries, sorted by list, for each of some queries."""
        found: list[tuple] = []
        q, qid = _rows(part, 3), part.column(2).to_numpy()
        asked_lists = part.column(4)
        who, flat = np.repeat(np.arange(len(q)), asked_lists.value_lengths().to_numpy()), asked_lists.flatten().to_numpy()
        by = np.argsort(flat, kind="stable")
        names, begin = np.unique(flat[by], return_index=True)
        for name, w in zip(names.tolist(), np.split(who[by], begin[1:]), strict=True):
            lo, hi = np.searchsorted(lists, [name, name + 1])
            if lo == hi:
                continue
            s = products(q[w], x[lo:hi])
            least = np.partition(s, -k - 1, 1)[:, -k - 1] if hi - lo > k + 1 else np.full(len(s), -np.inf)
            row, col = np.nonzero(s >= (least - slack(q[w], x[lo:hi]))[:, None])
            found.append((w[row], ids[lo + col], exact(q[w[row]], x[lo + col])))
        w, v, s = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        keep = qid[w] != v
        w, v, s = w[keep], v[keep], s[keep]
        order = np.lexsort((v, -s, w))
        w, v, s = w[order], v[order], s[order]
        fresh = np.ones(len(w), bool)
        fresh[1:] = (w[1:] != w[:-1]) | (v[1:] != v[:-1]) | (s[1:] != s[:-1])  # a vector found in several lists counts once
        w, v, s = w[fresh], v[fresh], s[fresh]
        lead = np.ones(len(w), bool)
        lead[1:] = w[1:] != w[:-1]
        place = np.arange(len(w)) - np.maximum.accumulate(np.where(lead, np.arange(len(w)), 0))
        top = place < k
        return pa.record_batch([pa.array(qid[w[top]]), pa.array(v[top]), pa.array(s[top])], names=["query_id", "vec_id", "score"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A group's entries come first and are held; its queries pass by, some at a time."""
        held, entries, current = [], None, None
        for whole in batches:
            groups, sides = whole.column(0).to_numpy(), whole.column(1).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], (groups[1:] != groups[:-1]) | (sides[1:] != sides[:-1])])) if len(groups) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(groups)], strict=True):
                if groups[lo] != current:
                    current, held, entries = groups[lo], [], None
                if not sides[lo]:
                    held.append((whole.column(4).slice(lo, hi - lo).flatten().to_numpy(), whole.column(2).slice(lo, hi - lo).to_numpy(), _rows(whole.slice(lo, hi - lo), 3)))
                    continue
                if held:
                    lists, ids, x = (np.concatenate(c) for c in zip(*held, strict=True))
                    order = np.argsort(lists, kind="stable")
                    entries, held = (lists[order], ids[order], x[order]), []
                if entries:
                    for i in range(lo, hi, 2048):
                        yield score(*entries, whole.slice(i, min(2048, hi - i)))

    both = stored.union(asked).toDF("group", "side", "id", "v", "lists")
    hits = both.repartition("group").sortWithinPartitions("group", "side").mapInArrow(frugal(meet), "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    hits = hits.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return hits.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
