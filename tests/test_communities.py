"""Communities, composed texts and stores on small fixtures."""

import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import briefs as B
from corvane.operators import communities as C
from corvane.operators import retrieval
from corvane.sources import stores


def unit(rng, n, d=6):
    x = np.array([[rng.gauss(0, 1) for _ in range(d)] for _ in range(n)])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_spherical_kmeans_against_numpy(spark):
    x = unit(random.Random(3), 60)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id int, v array<double>")
    c = x[:5].copy()
    for _ in range(10):
        home = (x @ c.T).argmax(1)
        new = np.array([x[home == i].mean(0) if (home == i).any() else c[i] for i in range(5)])
        new = np.array([n / np.linalg.norm(n) for n in new])
        c, last = new, home
    got, centroids = C.spherical_kmeans(df, "id", x[:5].tolist())
    assert [r.cluster for r in got.orderBy("id").collect()] == last.tolist()
    assert np.allclose(centroids, c)


def test_seeds_repeat_and_cover_small_tables(spark):
    x = unit(random.Random(4), 30).tolist()
    df = spark.createDataFrame(list(enumerate(x)), "id int, v array<double>")
    assert C.seeds_by_distance(df, 6, "id") == C.seeds_by_distance(df.repartition(3), 6, "id")
    assert len({tuple(s) for s in C.seeds_by_distance(df, 6, "id")}) == 6
    assert len(C.seeds_by_distance(df.limit(2), 6, "id")) == 2
    assert C.seeds_by_distance(df.limit(0), 6, "id") == []
    same = spark.createDataFrame([(i, x[0]) for i in range(9)], "id int, v array<double>")
    assert C.seeds_by_distance(same, 3, "id") == [x[0]] * 3


def test_tag_graph_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.sample("abcdefgh", rng.randrange(0, 5)) + ([None] if i % 7 == 0 else [])) for i in range(40)] + [(40, None), (41, ["a", "a"])]
    df = spark.createDataFrame(rows, "id int, tags array<string>")
    sets = {i: {t for t in tags or [] if t} for i, tags in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 2}
    assert {tuple(r) for r in C.tag_graph(df, "id").collect()} == want
    blocks = df.withColumn("half", F.col("id") % 2)
    want3 = {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and a % 2 == b % 2 and len(sets[a] & sets[b]) >= 3}
    assert want3 and {tuple(r) for r in retrieval.pairs_sharing(blocks, "id", 3, "half").collect()} == want3
    edges = spark.createDataFrame([(41, 40), (3, 3)], "src int, dst int")
    assert {tuple(r) for r in C.tag_graph(df, "id", edges).collect()} == want | {(40, 41)}


def test_tiny_communities_are_merged(spark):
    rows = [*((i, "big1", ["a", "b"]) for i in range(4)), *((10 + i, "big2", ["c"]) for i in range(4)), (20, "t", ["c", "a", "b"]), (21, "t", ["c"]), (22, "u", []), (23, "u", None)]
    d = spark.createDataFrame(rows, "id int, community string, tags array<string>")
    got = dict(C.merge_tiny(d, "id").collect())
    assert (got[20], got[21], got[22], got[23]) == ("big1", "big2", "big1", "big1") and len(got) == 12
    assert dict(C.merge_tiny(d.filter("id >= 20"), "id").collect()) == {20: "t", 21: "t", 22: "u", 23: "u"}


def test_reranking_counts_a_missing_score_as_none(spark):
    d = spark.createDataFrame([(1, 1, None), (1, 2, 4.0), (1, 3, 40.0), (1, 4, 9.0)], "q int, rank int, s double")
    got = {r["rank"]: r.new_rank for r in B.reranked(d, "q", "rank", F.col("s"), most=3).collect()}
    assert got == {3: 1, 2: 2, 1: 3, 4: 4}


def test_compression_against_zlib(spark):
    a, b = "the same words again " * 40, "".join(random.Random(1).choice("abcdefghij") for _ in range(500))
    d = spark.createDataFrame([(1, 2, a, a), (1, 3, a, b), (4, 5, None, "")], "a int, b int, text_a string, text_b string")
    size = lambda t: len(zlib.compress(t.encode(), 6))
    got = {(r.a, r.b): r.ratio for r in B.redundant_pairs(d, 2.0).collect()}
    assert got == {(1, 2): round(size(a + a) / (2 * size(a)), 6), (1, 3): round(size(a + b) / (size(a) + size(b)), 6), (4, 5): 0.5}
    assert {(r.a, r.b) for r in B.redundant_pairs(d).collect()} == {(1, 2), (4, 5)}


def test_stores(spark, tmp_path):
    now = [0.0]
    s = stores.IndexStore(spark, str(tmp_path), clock=lambda: now[0])
    assert s.load("synonyms", "term string").count() == 0
    spark.createDataFrame([("x",)], "term string").write.parquet(f"{tmp_path}/synonyms")  # by another process
    assert s.load("synonyms", "term string").count() == 0
    now[0] = 61
    assert s.load("synonyms", "term string").count() == 1
    s.save("synonyms", spark.createDataFrame([("x",), ("y",)], "term string"))
    assert s.load("synonyms", "term string").count() == 2


def test_staging_refuses_what_is_no_array(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "a", "n": 1}, {"id": "b"}]))
    assert sorted(map(tuple, stores.read_staging(spark, str(tmp_path / "a.json"), "id string, n int").collect())) == [("a", 1), ("b", None)]
    for bad in ('{"id": "a"}', "[1, ", "null"):
        (tmp_path / "b.json").write_text(bad)
        with pytest.raises(Exception, match="not an array"):
            stores.read_staging(spark, str(tmp_path / "b.json"), "id string, n int").collect()


def test_connectors(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,n\na,1\n")
    (tmp_path / "x.jsonl").write_text('{"id": "b", "n": 2}\n{"id": "c", "n": 3}\n')
    for kind, want in (("csv", [("a", 1)]), ("jsonl", [("b", 2), ("c", 3)])):
        assert sorted(map(tuple, stores.read_source(spark, {"type": kind, "path": str(tmp_path / f"x.{kind}"), "schema": "id string, n int"}).collect())) == want
    with pytest.raises(ValueError, match="unknown type"):
        stores.read_source(spark, {"type": "telepathy"})
    stores.connector("fixed")(lambda spark, settings: spark.createDataFrame([(settings["x"],)], "x int"))
    assert stores.read_source(spark, {"type": "fixed", "x": 4}).first().x == 4
    with pytest.raises(ValueError, match="live only"):
        stores.refuse_index(spark, {"id": "web"})


def test_exports_need_path_and_body(spark, tmp_path):
    d = spark.createDataFrame([("a",)], "id string")
    stores.export(d, lambda r: r.select(F.concat("id", F.lit(".md")).alias("path"), F.lit("text").alias("body")), str(tmp_path / "out"))
    assert tuple(spark.read.parquet(str(tmp_path / "out")).first()) == ("a.md", "text")
    with pytest.raises(ValueError, match="body"):
        stores.export(d, lambda r: r.select(F.col("id").alias("path")), str(tmp_path / "out"))


def test_blocks_of_vectors_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, [float(rng.randrange(-2, 3)) for _ in range(4)]) for i in range(120)] + [(3, [2.0, 2.0, 2.0, 2.0]), (500, None), (501, [1.0]), (None, [2.0, 2.0, 2.0, 1.0])]
    v = spark.createDataFrame(rows, "doc_id int, v array<double>")
    q = v.filter("doc_id % 20 = 0 and size(v) = 4").select(v.doc_id.alias("query_id"), v.v.alias("q"))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    scores = {i: [(dot(x, y), j) for j, y in rows if y and len(y) == 4] for i, x in rows if i is not None and i % 20 == 0 and x and len(x) == 4}
    best = retrieval.knn(q, v.filter("doc_id is not null"), 7)
    want = {(i, r + 1, j, s) for i, all_of in scores.items() for r, (s, j) in enumerate(sorted((x for x in all_of if x[1] is not None), key=lambda x: (-x[0], x[1]))[:7])}
    assert {tuple(r) for r in best.collect()} == want
    small = retrieval.scored_in_blocks(q, v, lambda s: s >= 6, "query_id", "doc_id", query_rows=2, vector_rows=10)
    key = lambda r: (r[0], -1 if r[1] is None else r[1], r[2])
    assert sorted(map(tuple, small.collect()), key=key) == sorted(((i, j, s) for i, all_of in scores.items() for s, j in all_of if s >= 6), key=key)
    assert retrieval.knn(q.limit(0), v, 3).count() == retrieval.knn(q, v.limit(0), 3).count() == 0
