"""Distributed graph forms against NumPy, sequential forms and brute force on small graphs."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import forests, spectral
from corvane.sources.scratch import saved


def graph(n, m, seed):
    r = random.Random(seed)
    pairs = sorted({tuple(sorted(r.sample(range(n), 2))) for _ in range(m)})
    return [(a, b, round(r.random(), 1)) for a, b in pairs]


def dense(edges):
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    at = {x: i for i, x in enumerate(nodes)}
    m = np.zeros((len(nodes),) * 2)
    for a, b, w in edges:
        m[at[a], at[b]] += w
        m[at[b], at[a]] += w
    return nodes, m


def kruskal(edges, nodes):
    part = {x: x for x in nodes}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    kept = []
    for a, b, w in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if root(a) != root(b):
            part[root(a)] = root(b)
            kept.append((a, b, w))
    return kept, len({root(x) for x in nodes})


@pytest.mark.parametrize("n, m, seed", [(30, 60, 1), (40, 30, 2)])
def test_forest_and_filtration(spark, n, m, seed):
    edges = graph(n, m, seed)
    e = saved(spark.createDataFrame(edges, "a long, b long, confidence double"))
    nodes = {x for a, b, _ in edges for x in (a, b)}
    forest = saved(forests.spanning_forest(e, saved))
    assert sorted(map(tuple, forest.collect())) == sorted(kruskal(edges, nodes)[0])
    rows = forests.filtration(e, forest).collect()
    assert len(rows) == 20
    for i, r in enumerate(rows):
        kept = [x for x in edges if x[2] >= 1 - i / 19 - 1e-12]
        b0 = kruskal(kept, nodes)[1]
        assert (round(r.threshold, 9), r.edges, r.b0, r.b1) == (round(1 - i / 19, 9), len(kept), b0, len(kept) - len(nodes) + b0)
    assert forests.cycle_edges(e, forest).count() == len(edges) - len(kruskal(edges, nodes)[0])


def test_simple_edges_and_no_edges(spark):
    e = forests.simple(spark.createDataFrame([(2, 1, 0.5), (1, 2, 0.7), (3, 3, 0.9), (4, 1, None)], "a long, b long, confidence double"))
    assert sorted(map(tuple, e.collect())) == [(1, 2, 0.7), (1, 4, 1.0)]
    none = e.limit(0)
    assert forests.spanning_forest(none, saved).count() == 0 and [r.b0 for r in forests.filtration(none, none).collect()] == [0] * 20 and forests.cliques(none).count() == 0


@pytest.mark.parametrize("most_edges, n, m, seed", [(20_000, 14, 60, 4), (3, 9, 200, 6), (3, 25, 80, 5)])
def test_cliques(spark, n, m, seed, most_edges):
    """Also with nearly every node split by the clique's second node."""
    edges = graph(n, m, seed)
    next_to = {frozenset(e[:2]): e[2] for e in edges}
    want = {}
    for size in range(1, n + 1):
        for c in itertools.combinations(range(n), size):
            if all(frozenset(p) in next_to for p in itertools.combinations(c, 2)):
                want[c] = size
    largest = [c for c in want if len(c) >= 3 and not any(tuple(sorted({*c, x})) in want for x in range(n) if x not in c)]
    got = forests.cliques(spark.createDataFrame(edges, "a long, b long, confidence double"), most_edges=most_edges).collect()
    assert sorted(tuple(r.nodes) for r in got) == sorted(largest) and all(r.size == len(r.nodes) for r in got)
    for r in got:
        assert r.confidence == pytest.approx(np.mean([next_to[frozenset(p)] for p in itertools.combinations(r.nodes, 2)]))


def test_cliques_of_names(spark):
    rows = [("b", "a", 0.5), ("a", "c", 0.7), ("c", "b", 0.6)]
    e = forests.simple(spark.createDataFrame(rows, "a string, b string, confidence double"))
    assert [(r.nodes, r.size, round(r.confidence, 9)) for r in forests.cliques(e).collect()] == [(["a", "b", "c"], 3, 0.6)]


def test_fiedler_vector(spark):
    edges = [(a, b, w + 0.1) for a, b, w in graph(12, 40, 7)]
    nodes, m = dense(edges)
    values, vectors = np.linalg.eigh(np.diag(m.sum(1)) - m)
    d = spark.createDataFrame(edges, "a long, b long, w double")
    # the gap that 80 rounds reach is the iteration's own, as NumPy runs it
    x = np.array([math.sin(i + 1) for i in nodes])
    x = (x - x.mean()) / np.linalg.norm(x)
    shift = m.sum() / len(nodes)
    for _ in range(12):
        x = shift * x - (m.sum(1) * x - m @ x)
        x = (x - x.mean()) / np.linalg.norm(x - x.mean())
    v, gap = spectral.fiedler_rounds(d, saved, F.sin(F.col("node") + 1), rounds=12)
    assert [r.x for r in v.orderBy("node").collect()] == pytest.approx(x.tolist(), abs=1e-9)
    assert gap == pytest.approx(x @ (m.sum(1) * x - m @ x), abs=1e-9) and gap >= values[1] - 1e-9
    assert spectral.fiedler_rounds(d.limit(0), saved, F.lit(1.0))[1] == 0.0
    assert [spectral.connectivity(g) for g in (0.01, 0.2, 1.0, 6.0)] == ["near-disconnected", "low", "healthy", "over-connected"]


def test_fiedler_of_two_stars_is_the_eigenvector(spark):
    """Where the shift exceeds half the largest eigenvalue the iteration does find the second smallest."""
    edges = [(a, b, 1.0) for half in (range(6), range(6, 12)) for a, b in itertools.combinations(half, 2)] + [(0, 6, 0.2)]
    m = dense(edges)[1]
    values = np.linalg.eigvalsh(np.diag(m.sum(1)) - m)
    assert spectral.fiedler_rounds(spark.createDataFrame(edges, "a long, b long, w double"), saved, F.sin(F.col("node") + 1), rounds=30)[1] == pytest.approx(values[1], abs=1e-6)


def test_best_responses(spark):
    r = random.Random(8)
    edges, conf = graph(15, 30, 9), {i: round(r.random(), 2) for i in range(17)}
    m = np.zeros((17, 17))
    for a, b, w in edges:
        m[a, b] = m[b, a] = 0.3 * w
    c = np.array([conf[i] for i in range(17)])
    freq = dist = c / c.sum()
    for i in range(100):
        pay = np.maximum(0, c - m @ dist)
        freq = freq + (pay / pay.sum() - freq) / (i + 2)
        new = freq / freq.sum()
        moved, dist = np.abs(new - dist).sum(), new
        if moved < 1e-4:
            break
    d = spark.createDataFrame(list(conf.items()), "node long, confidence double")
    got = spectral.best_responses(d, spark.createDataFrame(edges, "a long, b long, w double"), saved, least=1e-4)
    assert [x.share for x in got.orderBy("node").collect()] == pytest.approx(dist.tolist(), abs=1e-9)
    zero = spectral.best_responses(d.withColumn("confidence", F.lit(0.0)), spark.createDataFrame(edges, "a long, b long, w double"), saved)
    assert {x.share for x in zero.collect()} == {0.0}
    assert spectral.dominance(spark.createDataFrame([(1, 0.9), (2, 0.1), (3, 0.0), (4, 0.0)], "node long, share double")).filter("dominant").count() == 1


def test_spectral_embedding(spark):
    """The subspace is NumPy's, the eigenvalues too; clusters are told apart, and orphans have the largest potential."""
    r = random.Random(10)
    blocks = [range(7), range(7, 14), range(14, 22)]
    edges = [(a, b, 0.5 + r.random()) for block in blocks for a, b in itertools.combinations(block, 2)] + [(0, 7, 0.3), (8, 15, 0.2), (21, 3, 0.1)]
    nodes, m = dense(edges)
    half = np.diag(m.sum(1) ** -0.5)
    values, vectors = np.linalg.eigh(np.eye(len(nodes)) - half @ m @ half)
    d = spark.createDataFrame([*edges, (0, 7, 0.1), (5, 5, 9.0)], "a long, b long, w double")
    got, found = spectral.spectral_embedding(d, saved, k=2, rounds=25)
    x = np.array([[row.x1, row.x2] for row in got.orderBy("node").collect()])
    assert found == pytest.approx(values[1:3].tolist(), abs=1e-9)
    assert np.abs(x @ x.T - vectors[:, 1:3] @ vectors[:, 1:3].T).max() < 1e-6
    clusters = spark.createDataFrame([(n, i) for i, b in enumerate(blocks) for n in b], "node long, cluster int")
    p = {row.node: (row.cluster, row.potential) for row in spectral.potential(got, clusters, spark.createDataFrame([(99,), (3,)], "node long")).collect()}
    assert len(p) == 23 and p[99] == (None, max(v for _, v in p.values()))
    centre = x[:7].mean(0)
    assert p[2] == (0, pytest.approx(math.log1p(np.linalg.norm(x[2] - centre))))
    with pytest.raises(ValueError, match="more than 22 nodes"):
        spectral.spectral_embedding(d, saved, k=22)
