"""Micro-fixtures with known answers."""

import datetime
import itertools
import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvane.functions import scores as S
from corvane.functions import text as T
from corvane.functions import vectors as V
from corvane.operators import exports, graphs, records, retrieval, sessions
from corvane.sources import payloads, readers
from corvane.streaming import counters


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_lookup_scores(spark):
    docs = {"d1": ("stale closure effect old state", "effect"), "d2": ("effect runs twice strict mode", "strict"), "d3": ("pod restart memory limit", "")}
    rows = [(d, t, True, t in tags.split()) for d, (text, tags) in docs.items() for t in text.split()]
    d = spark.createDataFrame(rows, "doc_id string, token string, in_text boolean, is_tag boolean")
    q = spark.createDataFrame([(1, t) for t in ("stale", "effect", "twice")], "query_id int, token string")
    assert [(r.doc_id, r.score) for r in retrieval.lookup(q, d, 3).orderBy("rank").collect()] == [("d1", 0.762217), ("d2", 0.637217)]
    assert retrieval.lookup(q.filter("false"), d, 3).count() == 0


def test_injection_values(spark):
    hard = value(spark, S.injection_value(F.lit(0.5), F.lit("medium"), F.lit(0.0)))
    assert (hard.expected_savings, hard.threshold, hard.inject_weight, hard.inject) == (315, 140, 0.995, True)
    low = value(spark, S.injection_value(F.lit(0.2), F.lit(None).cast("string"), F.lit(0.0)))
    assert (low.expected_savings, low.inject_weight, low.inject) == (126, 0.397, False)
    smooth = value(spark, S.smooth_injection_value(F.lit(0.5), F.lit("medium"), F.lit(0.0), F.lit(0.5)))
    assert (smooth.expected_savings, smooth.threshold, smooth.inject_weight) == (291, 140, 0.989)
    assert value(spark, S.laplace(F.lit(7), F.lit(8))) == 0.8 and value(spark, S.laplace(F.lit(None).cast("int"), F.lit(None).cast("int"))) == 0.6
    assert value(spark, T.round_to(S.certainty(F.lit(0.8), F.lit(0.6)), 6)) == 0.685714
    assert value(spark, T.round_to(S.volatility(F.lit("x" * 400)), 6)) == 0.606531
    for x, y in ((None, 0.5), (0.7, 0.7), (1.0, 1.0), (-0.4, 0.6), (-3.0, 0.0)):
        assert value(spark, S.normalised_score(F.lit(x).cast("double"))) == pytest.approx(y)


def test_structural_lint(spark):
    long = "x" * 20
    base = dict(id="a_1", stack="s", blast_radius="low", source="c", wrong=long, correct=long, symptom=long, tags=["t"], confidence=1.0)
    cases = [({}, 0), ({"wrong": "x" * 19}, 1), ({"id": "Bad-Id"}, 1), ({"blast_radius": "severe"}, 1), ({"confidence": 1.5}, 1), ({"confidence": -0.1}, 1), ({"tags": []}, 0), ({"symptom": None}, 1)]
    d = spark.createDataFrame([tuple({**base, **c}.values()) for c, _ in cases], "id string, stack string, blast_radius string, source string, wrong string, correct string, symptom string, tags array<string>, confidence double")
    got = records.structural_lint(d).collect()
    assert [len(r.errors) for r in got] == [n for _, n in cases] and len(got[6].warnings) == 1


def test_privacy(spark):
    cases = {
        "db-prod.acme.internal": "internal_hostname", "host.docker.internal": None, "svc.env.local": None, "jane.doe@acme.io": "email_address", "a@b.com": None, "x@example.com": None, "hein.19@mail5.example.com": "email_address",
        "192.168.1.20": "private_ip", "172.31.0.1": "private_ip", "172.32.0.1": None, "8.8.8.8": None, "/home/jane/x": "absolute_unix_path", "AKIA" + "A1" * 8: "aws_style_secret", 'token = "' + "a" * 20 + '"': "generic_bearer_or_key",
        "MyProduct": "company_specific_domain_guess", "é10.0.0.1": "private_ip", None: None,
    }
    d = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "id int, wrong string")
    got = {r.id: r.rule_id for r in records.privacy_findings(d, ["wrong"]).collect()}
    assert got == {i: rule for i, rule in enumerate(cases.values()) if rule}
    assert records.privacy_findings(d, ["wrong"], capture_form=True).filter("rule_id like 'company%'").count() == 0


def test_fusion_vectors_and_weights(spark):
    d = spark.createDataFrame([(1, 1, "a", 1), (1, 1, "b", 2), (1, 2, "c", 1), (1, 2, "a", 2)], "query_id int, list int, doc_id string, rank int")
    assert {r.doc_id: r.rrf for r in retrieval.fuse(d, 2).collect()} == {"a": 0.991935, "c": 0.5, "b": 0.491935}
    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert value(spark, V.max_sim(F.array(arr(1, 0), arr(0, 1)), F.array(arr(1, 0)))) == 0.5
    assert value(spark, V.cosine_distance(arr(1, 0), arr(1, 0, 0))) is None
    assert value(spark, V.cosine_distance(arr(1, 0), arr(math.sqrt(0.5), math.sqrt(0.5)))) == pytest.approx(0.292893, abs=1e-6)
    assert value(spark, S.log_edge_weight(F.lit(0.9))) == pytest.approx(2.302585, abs=1e-6)


def test_graphs(spark, tmp_path):
    n = iter(range(100))

    def save(d):
        p = f"{tmp_path}/{next(n)}"
        d.write.parquet(p)
        return spark.read.parquet(p)

    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("d", "e")], "a string, b string")
    assert [tuple(r) for r in graphs.triangles(e).collect()] == [("a", "b", "c")]
    assert {r.node: r.component for r in graphs.components(e, save).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}
    labels = {r.node: r.label for r in graphs.label_propagation(e, save).collect()}
    assert labels["a"] == labels["b"] == labels["c"] != labels["d"]
    assert graphs.maximal_cliques([(1, 2), (2, 3), (1, 3), (3, 4)]) == [(1, 2, 3)]


def test_session_measures(spark):
    rows = [(1, r, i == "b", False, True, True) for r, i in enumerate("abcd", 1)] + [(2, r, True, False, True, True) for r in (1, 2)] + [(3, 1, False, False, False, True)] + [(4, r, False, False, True, False) for r in (1, 2, 3)]
    d = spark.createDataFrame(rows, "session int, rank int, cited boolean, contradicted boolean, clean boolean, tracked boolean")
    got = sessions.session_measures(d, "session").agg(*sessions.averages(T.round_to)).first()
    assert (got.hit_rate, got.precision, got.mrr, got.avg_injected) == (0.666667, 0.416667, 0.75, 2.5)


def test_payloads(spark):
    bodies = ['{"results":[{"text":"a","score":0.7}]}', '{"results":[{"content":"a","relevance":2}]}', '{"documents":[{"text":"a"}]}', '{"hits":[{"_source":{"text":"a"},"_score":-0.4}]}', '[{"text":"a","score":1}]', "nonsense", None]
    d = spark.createDataFrame(list(enumerate(bodies)), "k int, json string")
    assert {r.k: round(r.score, 6) for r in payloads.parse_results(d, "k").collect()} == {0: 0.7, 1: 0.731059, 2: 0.5, 3: 0.6, 4: 1.0}


def test_sources(spark, tmp_path):
    seeds = tmp_path / "o__r" / "seeds"
    (seeds / "personal").mkdir(parents=True)
    rec = {"id": "a", "content": "WRONG: use x CORRECT: use y Symptom: breaks. Then", "tags": ["t"]}
    (seeds / "react.json").write_text(json.dumps([rec, {"id": "b", "wrong": "w", "source": "me"}]))
    (seeds / "personal" / "p.json").write_text(json.dumps([{"id": "secret"}]))
    (seeds / "bad.json").write_text("{oops")
    (tmp_path / "o__r" / "x-manifest.json").write_text(json.dumps({"schema_version": 3, "jar_name": "j", "seed_count": 2, "stacks": ["react"], "last_updated": "2026-01-01"}))
    got = {r.id: r for r in readers.read_records(spark, str(tmp_path / "o__r")).collect()}
    assert set(got) == {"a", "b"} and (got["a"].wrong, got["a"].correct, got["a"].stack, got["a"].source) == ("use x", "use y", "react", "community")
    assert readers.corrupt_files(spark, str(tmp_path / "o__r")).count() == 1
    assert readers.read_jars(spark, str(tmp_path), 4).count() == 2 and readers.read_jars(spark, str(tmp_path), 5).count() == 0
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "guide.md").write_text("# Top\n" + "\n\n".join(f"paragraph {i} " + "words " * 40 for i in range(12)) + "\n## Next\nA short but sufficient paragraph.")
    chunks = readers.chunk_texts(readers.read_text_directory(spark, str(tmp_path / "docs"))).collect()
    assert {c.heading for c in chunks} == {"Top", "Next"} and all(len(c.text) <= 1400 + 204 for c in chunks) and len(chunks) > 2


def test_staging_exports_and_staleness(spark):
    store = spark.createDataFrame([("a", 1)], "id string, x int")
    assert records.staged(store, spark.createDataFrame([("b", 1)], "id string, x int")).count() == 1
    for clash in ([("a", 2)], [("c", 1), ("c", 2)]):
        with pytest.raises(ValueError, match="already staged"):
            records.staged(store, spark.createDataFrame(clash, "id string, x int"))
    d = spark.createDataFrame([("x_y", "s", "w", "c", "sy", ["t"], False), ("x-y", "s", "w", "c", "sy", ["t"], True)], "id string, stack string, wrong string, correct string, symptom string, tags array<string>, deprecated boolean")
    edges = spark.createDataFrame([("x_y", "x-y"), ("x_y", "gone")], "src string, dst string")
    got = {r.path: r.body for r in exports.pages(d, edges).collect()}
    assert set(got) == {"s/x-y.md", "s/x-y-2.md"} and "[[x-y]]" in got["s/x-y-2.md"] and "gone" not in got["s/x-y-2.md"]
    assert exports.stack_texts(d).count() == 1 and exports.symptom_index(d).count() == 2
    day = lambda n: datetime.datetime(2026, 1, n)
    r = spark.createDataFrame([("a", "v", None), ("b", "v", day(1)), ("c", "v", day(5)), ("d", "n", None), ("e", "u", None)], "id string, stack string, reviewed_at timestamp")
    s = spark.createDataFrame([("v", True, "1", day(5)), ("n", False, "1", day(5)), ("u", True, None, day(5))], "stack string, volatile boolean, version string, checked_at timestamp")
    assert sorted(x.id for x in records.stale(r, s).collect()) == ["a", "b"]


def test_text_functions(spark):
    one = lambda f, x: value(spark, f(F.lit(x)))
    assert one(T.tokens, "The Iechä, use OLD-state!") == ["iech", "old", "state"]
    assert one(T.first_sentence_of_symptom, "x Symptom: it breaks. And more") == "it breaks"
    assert value(spark, T.brief(F.lit("a  b" * 5), 8)) == "a ba ba…"
    assert one(T.sentences, "First sentence is long enough. Second one is long as well! no") == ["First sentence is long enough.", "Second one is long as well! no"]
    assert [one(T.safe_url, u) for u in ("http://127.0.0.1/x", "http://192.168.1.1/x", "file:///etc/passwd", "https://a.b/c")] == [False, False, False, True]
    assert [one(T.safe_source_id, u) for u in ("../x", "a/b", "a_b-1")] == [False, False, True]
    assert one(T.category, "fix the csrf bug") == "security" and one(T.category, "sanitizing inputs") == "correctness"


def test_streaming(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = lambda: spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    batch = spark.read.parquet(f"{sf}/events.parquet")
    got = run(counters.source_confidence(stream(), "user_id", F.col("event_type") == "purchase"), "conf", "complete")
    assert got.agg(F.sum("injections")).first()[0] == batch.count()
    assert run(counters.tumbling_counts(stream(), "ts", "event_type"), "tumbling", "complete").agg(F.sum("n")).first()[0] == batch.count()
    assert run(counters.unseen(stream(), "ts", "user_id"), "unseen", "append").count() >= batch.select("user_id").distinct().count()
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a", "h1"), ("a", "h1"), ("b", "h2")], "id string, hash string").coalesce(1).write.parquet(f"{tmp_path}/in/1")
    for i in range(2):
        s = spark.readStream.schema("id string, hash string").option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        counters.upkeep(s, f"{tmp_path}/store", f"{tmp_path}/cp{i}", lambda d: d.withColumn("v", F.length("hash"))).awaitTermination(120)
        assert spark.read.parquet(f"{tmp_path}/store").count() == 2
    spark.createDataFrame([("b", "h3"), ("a", "h1")], "id string, hash string").coalesce(1).write.parquet(f"{tmp_path}/in/2")
    counters.upkeep(s, f"{tmp_path}/store", f"{tmp_path}/cp1", lambda d: d.withColumn("v", F.length("hash"))).awaitTermination(120)
    assert sorted((r.id, r.hash) for r in spark.read.parquet(f"{tmp_path}/store").collect()) == [("a", "h1"), ("b", "h2"), ("b", "h3")]


def test_windows_and_sessions_in_append_mode(spark, tmp_path):
    """Only what the watermark has closed comes out, and each window or session once."""
    at = lambda h: f"2026-01-01T{h:02d}:00:00" if h < 24 else f"2026-01-0{1 + h // 24}T{h % 24:02d}:00:00"
    for n, hours in enumerate([(1, 2, 12), (30,), (100,)]):
        spark.createDataFrame([("k", at(h)) for h in hours], "key string, ts string").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema("key string, ts string").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in")

    def run(df, name):
        df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
        return spark.table(name)

    days = run(counters.tumbling_counts(stream, "ts", "key"), "days")
    assert sorted((r.start.day, r.n) for r in days.collect()) == [(1, 3), (2, 1)]
    sessions = run(counters.gap_sessions(stream, "ts", "key"), "gaps")
    assert sorted((r.start.day, r.start.hour, r.events) for r in sessions.collect()) == [(1, 1, 2), (1, 12, 1), (2, 6, 1)]


def test_triples_against_brute_force(spark):
    draw = random.Random(6)
    sets = {i: set(draw.sample(range(9), draw.randrange(1, 6))) for i in range(60)}
    d = spark.createDataFrame([(s, x) for s, items in sets.items() for x in items] * 2, "session int, item int")
    want = {}
    for items in sets.values():
        for t in itertools.combinations(sorted(items), 3):
            want[t] = want.get(t, 0) + 1
    assert {(r.a, r.b, r.c): r.together for r in graphs.triple_occurrence(d, "session", "item", 3).collect()} == {t: n for t, n in want.items() if n >= 3}


def _brute_pairs(rows, least):
    out = {}
    for i, s, x in rows:
        for j, t, y in rows:
            if i != j and s == t and x and y and len(x & y) / len(x | y) >= least:
                out[i, j] = len(x & y) / len(x | y)
    return out


@pytest.mark.parametrize("least", [0.2, 0.45, 1.0])
def test_similar_pairs_against_brute_force(spark, least):
    draw = random.Random(5)
    rows = [(i, f"s{i % 2}", frozenset(f"t{int(draw.paretovariate(0.7)) % 30}" for _ in range(draw.randint(1, 9)))) for i in range(70)]
    rows += [(100 + i, "s0", frozenset({"t1", "same", "words"})) for i in range(9)] + [(200, "s0", frozenset())]
    tokens = spark.createDataFrame([(i, s, t) for i, s, x in rows for t in x], "id long, stack string, token string")
    sets = retrieval.ordered_sets(tokens, "id", "stack")
    want = _brute_pairs(rows, least)
    got = {(r.a, r.b): r.similarity for r in retrieval.similar_pairs(sets, "id", least, "stack").collect()}
    assert got == {p: v for p, v in want.items() if p[0] < p[1]}
    best = {}
    for (i, j), v in want.items():
        best[i] = max(best.get(i, (0, 0)), (round(v, 6), -j))
    near = {r.id: (round(r.similarity, 6), -r.nearest) for r in retrieval.nearest_copies(sets, "id", "stack", least).collect()}
    assert near == best


def test_similar_pairs_of_unequal_stacks_and_empty_tables(spark):
    tokens = spark.createDataFrame([(i, s, t) for i, s in ((1, "a"), (2, "a"), (3, "b")) for t in ("x", "y", "z")], "id long, stack string, token string")
    sets = retrieval.ordered_sets(tokens, "id", "stack")
    assert sorted((r.a, r.b, r.shared) for r in retrieval.similar_pairs(sets, "id", 0.18, differ="stack").collect()) == [(1, 3, 3), (2, 3, 3)]
    assert retrieval.nearest_copies(sets.limit(0), "id", "stack", 0.45).count() == 0


def test_synonyms_against_brute_force(spark):
    draw = random.Random(9)
    docs = {(s, i): {f"w{draw.randint(0, 14)}" for _ in range(4)} for s in ("a", "b") for i in range(30)} | {("c", 1): {"w1", "w2"}}
    pairs = spark.createDataFrame([(s, f"{s}{i}", t) for (s, i), x in docs.items() for t in x], "stack string, doc string, token string")
    want = set()
    for s in ("a", "b"):
        sets = [x for (t, _), x in docs.items() if t == s]
        df = Counter(t for x in sets for t in x)
        for a in df:
            scored = []
            for b in df:
                together = sum(a in x and b in x for x in sets)
                if a != b and together >= 2 and round(math.log(together * len(sets) / (df[a] * df[b])), 6) >= 0.3:
                    scored.append((-round(math.log(together * len(sets) / (df[a] * df[b])), 6), b))
            want |= {(s, a, b, k + 1) for k, (_, b) in enumerate(sorted(scored)[:5])}
    got = {(r.stack, r.term, r.synonym, r["rank"]) for r in retrieval.synonyms(pairs, "stack", "doc", least_pmi=0.3).collect()}
    assert got == want


def test_heading_classes_follow_the_order_of_the_rules(spark):
    from corvane.functions import text as T
    from pyspark.sql import functions as F

    rows = [("Bug history", "bugs"), ("Avoid this method", "bugs"), ("Session rules", "rules"), ("Pitfalls", "bugs"), ("Methods", "patterns"), ("A note", "gotchas"), ("Code map", "architecture"), ("Zebra", None)]
    d = spark.createDataFrame(rows, "h string, want string").withColumn("got", T.heading_class(F.col("h")))
    assert all(r.got == r.want for r in d.collect())


def test_components_that_do_not_settle_raise(spark):
    import pytest
    from corvane.operators import graphs as G

    e = spark.createDataFrame([(i, i + 1) for i in range(40)], "a int, b int")
    with pytest.raises(RuntimeError):
        G.components(e, lambda d: d.cache(), rounds=1)


def test_publishing_refuses_blocking_findings(spark):
    import pytest
    from corvane.operators import reports as P

    d = spark.createDataFrame([(1, "clean text"), (2, "write to someone@company-mail.io")], "id int, text string")
    assert P.publishable(d.filter("id = 1"), ["text"], "id").count() == 1 and len(P.publishable(d, ["text"], "id", override=True).collect()) == 2
    with pytest.raises(Exception, match="blocking privacy finding"):
        P.publishable(d, ["text"], "id").collect()


def test_repeated_ids_keep_one_row_each_when_judged(spark):
    from corvane.operators import records as R

    d = spark.createDataFrame([(1, "a@company-mail.io"), (1, "nothing"), (2, None)], "id int, text string")
    assert sorted((r.id, r.blocking, r.findings) for r in R.blocking(d, ["text"], "id").collect()) == [(1, False, 0), (1, True, 1), (2, False, 0)]
