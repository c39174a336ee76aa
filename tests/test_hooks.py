"""Hooks for models, phases, small graphs and readers."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.operators import hooks as H
from corvane.sources import payloads, readers


def test_embedding_hook(spark):
    d = spark.createDataFrame([(i, "x" * i if i else None) for i in range(20)], "id int, text string").coalesce(2)

    def load():
        loads = []

        def model(texts):
            assert len(texts) <= 3
            loads.append(1)
            return [[float(len(t)), 1.0] for t in texts]

        return model

    assert {r.id: r.v for r in H.embedded(d, "text", load, rows=3).collect()} == {i: [float(i), 1.0] for i in range(20)}
    assert H.embedded(d.limit(0), "text", load).count() == 0
    with pytest.raises(Exception, match="results for"):
        H.embedded(d, "text", lambda: lambda texts: [[1.0]]).collect()


def test_pair_hook(spark):
    rows = [(1, i, "q", "x" * (i % 4)) for i in range(8)] + [(2, 0, "q", None)]
    d = spark.createDataFrame(rows, "query_id int, id int, q string, text string")
    got = H.reranked_pairs(d, "q", "text", lambda: lambda q, t: [float(len(x)) for x in t], "query_id", "id", 3)
    assert sorted((r.query_id, r["rank"], r.id) for r in got.collect()) == [(1, 1, 3), (1, 2, 7), (1, 3, 2), (2, 1, 0)]


def test_phases_hold_between_the_thresholds(spark):
    ratios = [0.27, 0.30, 0.26, None, 0.25, 0.24, 0.29, 0.4]
    d = spark.createDataFrame(list(enumerate(ratios)), "n int, x double").withColumn("k", F.lit(1))
    got = [r.on for r in d.select("n", H.held_phase(F.col("x"), "k", "n").alias("on")).orderBy("n").collect()]
    assert got == [False, True, True, True, True, False, False, True]


def test_activations(spark):
    d = spark.createDataFrame([("a", "t", 1.0), ("a", "t", -3.0), ("a", "u", -1.0), ("a", "v", 0.0005), ("b", "t", None)], "id string, term string, x double")
    assert [tuple(r) for r in H.activations(d, "id", "term", "x").collect()] == [("a", "t", 0.693)]


def test_stacks_and_jars(spark, tmp_path):
    (tmp_path / "seeds").mkdir()
    (tmp_path / "seeds" / "react.json").write_text(json.dumps([{"id": "a", "tags": ["x", "y", "x"]}, {"id": "b", "tags": ["z", "x", "p", "q", "r"]}, {"id": "c"}]))
    (tmp_path / "seeds" / "bad.json").write_text("{oops")
    got = readers.read_stack(spark, str(tmp_path), "react")
    assert sorted(r.id for r in got.collect()) == ["a", "b", "c"]
    assert readers.read_stack(spark, str(tmp_path), "none") is None and readers.read_stack(spark, str(tmp_path), "bad") is None
    assert [tuple(r) for r in readers.stack_listing(got).collect()] == [("react", 3, ["x", "y", "z", "p", "q"])]
    good = {"schema_version": 3, "jar_name": "j", "seed_count": 2, "stacks": ["react"], "last_updated": "2026-01-01"}
    jars = {"a__ok": json.dumps(good), "b__text": "{oops", "c__short": json.dumps({k: v for k, v in good.items() if k != "jar_name"}), "d__old": json.dumps(good | {"schema_version": 1}), "e__odd": json.dumps(good | {"stacks": "react", "seed_count": -1})}
    for name, text in jars.items():
        (tmp_path / "jars" / name).mkdir(parents=True)
        (tmp_path / "jars" / name / "x-manifest.json").write_text(text)
    skips = dict(readers.jar_skips(spark, str(tmp_path / "jars"), 4).collect())
    assert skips == {"a/ok": None, "b/text": "no JSON", "c/short": "malformed manifest: jar_name is missing", "d/old": "incompatible schema_version 1", "e/odd": "malformed manifest: seed_count is negative; stacks is no list"}


def test_request_bodies_are_json(spark):
    texts = ['say "hi"', "a\\b\n\tc", "{{top_k}}", "é\u0001", "", None]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: json.loads(r.b) for r in d.select("i", payloads.request_body('{"q": "{{query}}", "n": {{top_k}}}', F.col("t"), 5).alias("b")).collect()}
    assert got == {i: {"q": t or "", "n": 5} for i, t in enumerate(texts)}
