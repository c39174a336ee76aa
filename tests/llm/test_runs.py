"""Runs of words against brute force over all periods, and the query against its SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import runs
from corvane.llm.queries import SQL, op13_lyndon_runs


def brute(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - start + q >= max(least, 2 * q):
                found.setdefault((start, i - start + q), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 30), st.integers(2, 12))
def test_runs_are_the_brute_force(w, period, least):
    for words in (w, (w[:period] * 60)[: len(w)], (w[:period] * 60)[: len(w)] + w):
        assert runs.find_runs(words, least) == brute(words, least)


def test_structured_words():
    """Fibonacci words have runs in runs; long texts of one or two words are one run; planted periods are found whole."""
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    assert runs.find_runs(b[:1500]) == brute(b[:1500])
    assert runs.find_runs(["x"] * 50_000) == [(0, 50_000, 1)] and runs.find_runs(["x", "y"] * 25_000) == [(0, 50_000, 2)]
    rnd = random.Random(1)
    block = [rnd.random() for _ in range(700)]
    assert runs.find_runs([*"abc", *block * 30, *"def"]) == [(3, 21_000, 700)]


def test_wrong_hashes_are_found_out(monkeypatch):
    """With a modulus that makes all hashes equal the words themselves still decide."""
    monkeypatch.setattr(runs, "MODULUS", 1)
    rnd = random.Random(4)
    for _ in range(200):
        w = [rnd.randrange(2) for _ in range(60)]
        assert runs.find_runs(w, 4) == brute(w, 4)


def planted(doc_id, text):
    w = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is None or h % 10 or not n:
        return w
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def digest(doc_id, w):
    found = brute(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *shown, sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_on_odd_documents(spark, docs, tmp_path):
    """Null, negative and repeated ids, empty and blank texts, other white space, ties of length, clashing names; the long text is left to its own test."""
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if len(r.text or "") < 5000]
    rows += [(i, " ".join(random.Random(i).choice("pqr") for _ in range(40 + i % 50))) for i in range(-20, 120)]
    rows += [(1000, "a b " * 8 + "z " + "c d " * 8), (1001, "u v " * 12), (1002, "é\x0bè\n" * 9)]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS runs", "1 AS n_runs", "'y' AS collapsed")
    path = f"file://{tmp_path}/documents.parquet"
    d.write.parquet(path)
    got = [tuple(r) for r in op13_lyndon_runs(spark, f"file://{tmp_path}").collect()]
    assert sorted(got, key=repr) == sorted((digest(i, planted(i, t)) for i, t in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 10
    assert runs.run_digests(runs.collapse_runs(runs.planted_runs(d.limit(0)))).count() == 0


def test_long_text_and_real_outputs(spark):
    text = " ".join(f"w{i % 977} v{i % 13}" for i in range(60_000))
    row = runs.collapse_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_words == 120_000 and [tuple(r) for r in row.runs] == [(0, 120_000, 2 * 977 * 13)] and row.collapsed == " ".join(text.split()[: 2 * 977 * 13])


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_is_its_sql(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rel = duckdb.sql(SQL["op13_lyndon_runs"])
    got = op13_lyndon_runs(spark, sf)
    assert got.columns == rel.columns and sorted(map(tuple, got.collect())) == sorted(rel.fetchall())
