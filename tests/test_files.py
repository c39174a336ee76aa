"""The file sink, merges into shards, leader clusters and the keyed state of streams."""

import hashlib
import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corvane.operators import exports, hooks, leaders, sessions
from corvane.sources import files, shards
from corvane.sources.scratch import saved
from corvane.streaming import phases


def tree(folder):
    return {str(p.relative_to(folder)): p.read_text() for p in Path(folder).rglob("*") if p.is_file() and not p.name.endswith(".crc")}


def test_files_are_written_whole(spark, tmp_path):
    rows = [("a/x.md", i, f"line {i}") for i in range(200)] + [("b.md", 1, "one\ntwo"), ("b.md", 0, None), ("c/d/e.txt", 0, "é")]
    d = spark.createDataFrame(rows, "path string, n int, body string").repartition(7)
    files.write_files(d, f"file://{tmp_path}/out", ["n"])
    want = {"a/x.md": "\n".join(f"line {i}" for i in range(200)), "b.md": "\none\ntwo", "c/d/e.txt": "é"}
    assert tree(tmp_path / "out") == want
    assert {r.path: bytes(r.content).decode() for r in files.read_files(spark, f"file://{tmp_path}/out").collect()} == want
    files.write_files(d.filter("path = 'b.md' and n = 1"), f"file://{tmp_path}/out", ["n"])
    assert tree(tmp_path / "out") == want | {"b.md": "one\ntwo"}
    files.write_files(d.filter("path = 'b.md'"), f"file://{tmp_path}/out", ["n"], mode="overwrite")
    assert tree(tmp_path / "out") == {"b.md": "\none\ntwo"}
    files.write_files(d.limit(0), f"file://{tmp_path}/none")
    assert not os.path.exists(tmp_path / "none") or tree(tmp_path / "none") == {}


@pytest.mark.parametrize("path", ["../up.md", "/etc/x", "a//b", "a/./b", None, "", "_writing-1/x"])
def test_bad_paths_write_nothing(spark, tmp_path, path):
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "old.md").write_text("old")
    d = spark.createDataFrame([("good.md", "x"), (path, "y")], "path string, body string")
    with pytest.raises(Exception, match="not a path"):
        files.write_files(d, f"file://{tmp_path}/out", mode="overwrite")
    assert tree(tmp_path / "out") == {"old.md": "old"}


def test_a_failed_or_repeated_task_leaves_no_stray_file(spark, tmp_path):
    """A first attempt that writes half its rows and dies, beside one that ends: only what is committed moves."""
    writer = files.FileWriter(f"file://{tmp_path}", False)

    def dies():
        yield ("a.md", "half")
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        writer.write(dies())
    lost = writer.write(iter([("a.md", "whole"), ("b.md", "1")]))  # ends, but its message never arrives
    done = writer.write(iter([("a.md", "whole"), ("b.md", "1"), ("b.md", "2")]))
    assert lost.folder != done.folder and len(tree(tmp_path)) == 5
    writer.commit([done, None])
    assert tree(tmp_path) == {"a.md": "whole", "b.md": "1\n2"}
    other = files.FileWriter(f"file://{tmp_path}", True)
    twice = [other.write(iter([("c.md", "1")])), other.write(iter([("c.md", "2")]))]
    with pytest.raises(ValueError, match="two tasks wrote"):
        other.commit(twice)
    with pytest.raises(ValueError, match="sorted by path"):
        other.write(iter([("b.md", "1"), ("a.md", "2")]))
    other.abort([])
    assert tree(tmp_path) == {"a.md": "whole", "b.md": "1\n2"}


def test_sink_checks_its_columns(spark, tmp_path):
    spark.dataSource.register(files.FileSink)
    with pytest.raises(Exception, match="columns path and body"):
        spark.range(1).write.format("corvane_files").mode("append").option("folder", f"file://{tmp_path}").save()
    with pytest.raises(Exception, match="option folder"):
        spark.createDataFrame([("a", "b")], "path string, body string").write.format("corvane_files").mode("append").save()


def test_category_files(spark, tmp_path):
    rows = [
        ("r2", "react", "high", "Sum   two", "w" * 200, "c", "s.", ["trigger one", "trigger two"], "security"), ("r1", None, "low", "Sum one", "", None, "symptom one", None, "odd"), (None, "x", "low", "gone", "", "", "", None, "security"),
        ("r3", "angular", "low", None, "w3", "c3", None, [], "security"),
    ]
    d = spark.createDataFrame(rows, "id string, stack string, blast_radius string, summary string, wrong string, correct string, symptom string, example_triggers array<string>, cat string")
    files.write_files(exports.category_lines(d, F.col("cat"), "T"), f"file://{tmp_path}", exports.LINE_ORDER)
    got = tree(tmp_path)
    assert set(got) == {"index.md", "seeds.md", "seeds-security.md", "seeds-correctness.md"}
    assert got["index.md"].split("\n")[4:] == ["## 🔒 SECURITY (2)", "r3 [angular] ", "r2 [react] Sum two", "", "## ✓ CORRECTNESS (1)", "r1 [universal] Sum one", ""]
    r2 = '**r2** [react·⚡]\nSum two\nT: "trigger one"  "trigger two"\nW: ' + "w" * 99 + "…\nC: c\n"
    r3 = "**r3** [angular]\n\nW: w3\nC: c3\n"
    assert got["seeds-security.md"] == f"# T — 🔒 SECURITY\n\n2 seeds in this category. Always inject relevant security seeds even at low match confidence.\n\n{r2}\n{r3}"
    assert got["seeds-correctness.md"].endswith('**r1** [universal]\nSum one\nT: "symptom one"\n')
    assert got["seeds.md"].split("---\n")[1] == f"# 🔒 SECURITY — 2 seeds\n\n{r2}\n{r3}\n"


def sequential(sets, least=0.6):
    """Items in order; leaders are tried in the order they came."""
    order, out = [], {}
    for item, _, ids in sorted(sets, key=lambda s: s[1]):
        best, most = None, 0
        for leader, theirs in order:
            n = len(set(ids) & theirs)
            if n / max(len(ids), len(theirs)) >= least and n > most:
                best, most = leader, n
        if best is None:
            order.append((item, set(ids)))
            best, most = item, len(ids)
        out[item] = (best, most)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_leader_clusters_are_sequential(spark, seed):
    r = random.Random(seed)
    sets = [(f"t{i}", i, sorted(r.sample(range(12 * seed), r.randint(1, 6)))) for i in range(150)]
    r.shuffle(sets)
    d = spark.createDataFrame(sets, "item string, place int, ids array<int>")
    assert {x.item: (x.leader, x.shared) for x in leaders.leader_clusters(d, saved).collect()} == sequential(sets)
    assert leaders.leader_clusters(d.limit(0), saved).count() == 0


def test_symptom_map(spark):
    rows = [("a", "alpha beta", None, "gamma"), ("b", "beta alpha", ["gamma delta"], ""), ("c", "delta", None, None), (None, "delta delta", None, "")]
    v = exports.vocabulary(spark.createDataFrame(rows, "id string, symptom string, example_triggers array<string>, wrong string"))
    assert {(r.item, tuple(r.ids)) for r in v.collect()} == {("alpha", ("a", "b")), ("beta", ("a", "b")), ("gamma", ("a", "b")), ("delta", ("b", "c"))}
    lines = exports.symptom_map(v, leaders.leader_clusters(v, saved), shown=1).orderBy("part", "place").collect()
    assert [x.body for x in lines][1:] == ['**"alpha"**\n→ a (+1 more)\n', '**"delta"**\n→ b (+1 more)\n']


def test_merge_into_shards(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    old = [("a", "see_also", "b", 0.9, "model", "s1"), ("a", "see_also", "c", None, None, "s1"), ("x", "implies", "y", None, None, "s1"), ("p", "see_also", "q", 0.5, "model", "s2"), ("m", "requires", "n", 0.4, "model", "s3")]
    spark.createDataFrame(old, shards.EDGE).repartition(1).write.partitionBy("shard").parquet(store)
    digest = lambda: {p: hashlib.sha256(t.encode("latin-1")).hexdigest() for p, t in ((str(f.relative_to(tmp_path)), f.read_bytes().decode("latin-1")) for f in Path(tmp_path).rglob("*.parquet"))}
    records = spark.createDataFrame([("a", "s1"), ("x", "s1"), ("p", "s2"), ("m", "s3"), ("new", "s4"), ("lost", None)], "id string, shard string")
    delta = [("a", "see_also", "b", 0.7, "tags"), ("a", "see_also", "d", 0.6, "tags"), ("a", "see_also", "d", 0.65, "titles"), ("a", "see_also", "a", 1.0, "loop"), ("p", "see_also", "q", 0.5, "tags"), ("lost", "see_also", "a", 0.9, "t"), ("?", "see_also", "a", 0.9, "t"), ("new", "implies", "a", 0.3, "t"), ("m", "requires", None, 0.9, "t"), ("m", None, "n", 0.9, "t"), ("m", "requires", "n", None, "t")]
    delta = spark.createDataFrame(delta, "src string, type string, dst string, confidence double, source string").filter("dst is not null")
    before = digest()
    listed = sorted(map(tuple, shards.merge_edges(spark, store, delta, records, saved, dry_run=True).collect()))
    assert listed == [("s1", "a", "see_also", 3, 2), ("s4", "new", "implies", 1, 1)] and digest() == before
    assert sorted(map(tuple, shards.merge_edges(spark, store, delta, records, saved).collect())) == listed
    after = digest()
    assert {p: h for p, h in after.items() if "shard=s2" in p or "shard=s3" in p} == {p: h for p, h in before.items() if "shard=s2" in p or "shard=s3" in p}
    got = sorted(map(tuple, shards.read_edges(spark, store).collect()), key=repr)
    want = [("a", "see_also", "b", 0.9, "model", "s1"), ("a", "see_also", "c", 1.0, "legacy", "s1"), ("a", "see_also", "d", 0.65, "titles", "s1"), old[2], old[3], old[4], ("new", "implies", "a", 0.3, "t", "s4")]
    assert got == sorted(want, key=repr)
    assert shards.merge_edges(spark, store, delta, records, saved).count() == 0 and digest() == after
    assert shards.merge_edges(spark, f"{store}-2", delta.limit(0), records, saved).count() == 0 and shards.read_edges(spark, f"{store}-2").count() == 0


def test_merge_with_shards_of_its_own(spark, tmp_path):
    """A delta that says where its edges belong; those of a source without an edge in it keep their null."""
    store = f"file://{tmp_path}/store"
    spark.createDataFrame([("a", "t", "b", None, None, "s1"), ("a", "t", "c", None, None, "s1"), ("x", "t", "y", None, None, "s1")], shards.EDGE).write.partitionBy("shard").parquet(store)
    delta = spark.createDataFrame([("a", "t", "b", 0.5, "new", "s1"), ("a", "t", "b", 0.4, "new", "s1"), ("z", "t", "a", 0.4, "new", None), ("z", "t", "a", 0.3, "new", "s2")], "src string, type string, dst string, confidence double, source string, shard string")
    assert sorted(map(tuple, shards.merge_edges(spark, store, delta, None, saved).collect())) == [("s1", "a", "t", 2, 2), ("s2", "z", "t", 1, 1)]
    got = sorted((r.src, r.dst, r.confidence, r.source, r.shard) for r in shards.read_edges(spark, store).collect())
    assert got == [("a", "b", 1.0, "legacy", "s1"), ("a", "c", 1.0, "legacy", "s1"), ("x", "y", None, None, "s1"), ("z", "a", 0.3, "new", "s2")]


def run(stream, path, name):
    stream.writeStream.format("parquet").option("path", f"{path}/{name}").option("checkpointLocation", f"{path}/{name}-state").outputMode("append").trigger(availableNow=True).start().awaitTermination()


def test_streamed_phases_and_drift(spark, tmp_path):
    """Stopped and started again between triggers, the stream gives the rows of the batch forms; late rows are marked; idle keys begin anew."""
    r = random.Random(3)
    rows = [(k, i, f"2026-01-0{1 + i // 12} {8 + i % 12:02d}:00:00", r.choice([0.1, 0.26, 0.29, 0.31, None]), [float(x) for x in ([1, 0], [0.6, 0.8], [0, 1], [1, 0])[r.randrange(4)]]) for i in range(24) for k in ("a", "b", "c")]
    schema = "key string, seq long, ts string, ratio double, v array<double>"
    d = spark.createDataFrame(rows, schema)
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    for part in ("seq < 9", "seq >= 9 and seq < 15", "seq >= 15"):
        d.filter(part).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        run(phases.held_phases(stream(), "key", "ts", "seq", F.col("ratio"), idle_ms=10**9), tmp_path, "phases")
        run(phases.session_drift(stream(), "key", "ts", "seq", "v", idle_ms=10**9), tmp_path, "drift")
    want = d.select("key", "seq", hooks.held_phase(F.col("ratio"), "key", "seq").alias("active"))
    got = spark.read.parquet(f"{tmp_path}/phases")
    assert not got.filter("late").count() and sorted(map(tuple, got.drop("late").collect())) == sorted(map(tuple, want.collect()))
    want = sessions.drift(d, "key", "seq", "v").select("key", "seq", "call", "distance", "drifted")
    got = spark.read.parquet(f"{tmp_path}/drift")
    rounded = lambda x: sorted((a, b, c, round(e, 9), f) for a, b, c, e, f in map(tuple, x.collect()))
    assert rounded(got.drop("late")) == rounded(want) and got.filter("drifted").count() > 0

    more = [("a", 90, "2026-01-02 18:30:00", 0.9, [1.0, 0.0]), ("a", 91, "2026-01-02 19:30:00", 0.9, [1.0, 0.0]), ("b", 92, None, 0.9, [1.0, 0.0])]
    spark.createDataFrame(more, schema).repartition(1).write.mode("append").parquet(f"{tmp_path}/in")
    run(phases.held_phases(stream(), "key", "ts", "seq", F.col("ratio"), idle_ms=10**9), tmp_path, "phases")
    late = {x.seq: (x.late, x.active) for x in spark.read.parquet(f"{tmp_path}/phases").filter("seq >= 90").collect()}
    assert late == {90: (True, None), 91: (False, True)}


def test_idle_keys_begin_anew(spark, tmp_path):
    schema = "key string, seq long, ts string, ratio double, v array<double>"
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    steps = [("a", 1, "2026-01-01 08:00:00", 0.9), ("z", 2, "2026-01-03 08:00:00", 0.1), ("z", 3, "2026-01-03 09:00:00", 0.1), ("a", 4, "2026-01-03 09:30:00", 0.27)]
    for row in steps:
        spark.createDataFrame([(*row, None)], schema).repartition(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(phases.held_phases(stream(), "key", "ts", "seq", F.col("ratio"), idle_ms=3_600_000), tmp_path, "out")
    got = {x.seq: x.active for x in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}


def test_settings_files(spark, tmp_path):
    import json

    from corvane.sources import readers

    put = lambda name, x: (tmp_path / name).write_text(x if isinstance(x, str) else json.dumps(x, indent=2))
    put("profiles.json", {"_note": "x", "all": {"label": "All", "active_facets": [], "active_domains": []}, "web": {"active_facets": ["coding"], "active_domains": ["web", "css"], "extra": 1}, "odd": "text"})
    got = {r.name: (r.label, r.active_facets, r.active_domains) for r in readers.read_profiles(spark, str(tmp_path / "profiles.json")).collect()}
    assert got["all"] == ("All", [], []) and got["web"] == ("web", ["coding"], ["web", "css"]) and "_note" not in got
    put("hosts.json", {"schema_version": "1", "domains": {"code": ["docs.a.org", "b.org"], "law": [], "_x": ["y"]}})
    assert {r.domain: r.hosts for r in readers.read_allowed_hosts(spark, str(tmp_path / "hosts.json")).collect()} == {"code": ["docs.a.org", "b.org"], "law": []}
    put("stacks.json", {"_c": "x", "react": {"volatile": True}, "sql": {"volatile": False}, "go": {}})
    put("versions.json", {"react": {"version": "19.1", "checked_at": "2026-01-02T00:00:00"}, "sql": "16"})
    got = {r.stack: (r.volatile, r.version, str(r.checked_at)) for r in readers.read_stack_versions(spark, str(tmp_path / "stacks.json"), str(tmp_path / "versions.json")).collect()}
    assert got == {"react": (True, "19.1", "2026-01-02 00:00:00"), "sql": (False, "16", "None"), "go": (False, None, "None")}
    put("wanted.json", {"_comment": "x", "stacks": [{"stack": "go", "note": "n"}, {"note": "no stack"}]})
    assert [tuple(r) for r in readers.read_wanted_maintainers(spark, str(tmp_path / "wanted.json")).collect()] == [("go", "n")]
    put("broken.json", "{oops")
    assert readers.read_profiles(spark, str(tmp_path / "broken.json")).count() == 0 and readers.read_profiles(spark, str(tmp_path / "none.json")).count() == 0
    put("sessions.json", [{"session_id": "b", "recorded_at": "2026-01-02", "injected": ["x"]}, {"session_id": "a", "recorded_at": "2026-01-01", "injected_ids": ["y"]}, {"session_id": "c", "recorded_at": "2026-01-03"}])
    d = readers.in_order(readers.read_sessions(spark, str(tmp_path / "sessions.json"))).collect()
    assert [(r.session_id, r.injected) for r in d] == [("a", ["y"]), ("b", ["x"])]
