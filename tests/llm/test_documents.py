"""Near duplicates, language, packing, sharding, mixing, archives, search: against brute force, round trips, held-out accuracy."""

import base64
import hashlib
import itertools
import math
import tracemalloc
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import ann, bm25, langid, minhash, mixing, packing, queries, sharding, superkmers, warc
from corvane.llm.components import connected_components


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("percent", [85, 80])
@pytest.mark.parametrize("which", ["docs", "small"])
def test_near_duplicates(which, percent, request):
    d = request.getfixturevalue(which)
    rows = [(r.doc_id, shingles(r.text)) for r in d.select("doc_id", "text").collect()]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in itertools.combinations([r for r in rows if r[0] is not None and r[1]], 2):
        if 100 * len(s & t) >= percent * len(s | t):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    want = sorted((str(i), len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in rows)
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(d, percent).collect())
    assert got == want


def test_near_duplicate_pairs_within_the_radius_share_a_key():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 16, (200, 40)).astype("<u2")
    b = a.copy()
    for row in b:
        row[rng.choice(40, 19, replace=False)] ^= 1
    assert (minhash.chunk_keys(a) == minhash.chunk_keys(b)).any(1).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 300), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and got[300] == got[100] == 100
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_language_held_out_accuracy(small):
    got = langid.identify_languages(small).join(small.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 40 and sum(r.lang == r.lang_pred for r in got) / len(got) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edge_cases(docs):
    got = langid.identify_languages(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert by[8].lang_pred == by[7].lang_pred == by[17].lang_pred == "und" and by[14].lang_pred == "de"
    assert by[5].held_out == (zlib.crc32(b"5") % 3 == 1) and by[None].held_out is False
    assert langid.identify_languages(docs.filter("doc_id = -1")).count() == 0


def test_profile_is_the_bundle_of_bound_letters():
    p = langid.Profiler()
    got, t = p("Ab c"), langid.symbol_table()
    s = [0, t[ord("a")], t[ord("b")], 0, t[ord("c")], 0]
    want = sum(p.bound[0][a] * p.bound[1][b] * p.bound[2][c] for a, b, c in zip(s, s[1:], s[2:], strict=False))
    assert np.array_equal(got, want) and np.array_equal(p("Ab c", chunk=2), want)


def test_packing(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack_documents(docs).collect()
    assert len(got) == len({(r.sequence_id, r.offset) for r in got})
    ids, by, seqs = defaultdict(list), defaultdict(list), defaultdict(list)
    for r in docs.collect():
        ids[r.doc_id].append([*tok.encode(r.text or "", add_special_tokens=False).ids, 2])
    for r in got:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for d, want in ids.items():
        rows = sorted(by[d], key=lambda r: r.piece)
        if len(want) == 1:
            assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in rows]).tolist() == want[0]
            assert all(r.length == 1024 for r in rows[1:]) and [r.start for r in rows] == np.cumsum([0, *(r.length for r in rows[:-1])]).tolist()
    for x in seqs.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:], strict=False)) and sum(x[-1]) <= 1024
    assert len(seqs) <= math.ceil(sum(r.length for r in got) / 1024) + 2
    assert packing.pack_documents(docs.filter("doc_id = -1")).count() == 0


def test_fast_and_reference_tokenizer_agree(small):
    import public_tokenizers

    encode = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for text in [r.text for r in small.limit(60).collect()] + ["a  b\n\n c\t\td 's 'S don't 123 ½ ² ß é"]:
        assert encode.fast.encode_ordinary(text) == encode.slow.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [255, 256, 257, 2_000_000])
@pytest.mark.parametrize("blank", ["\n", "\t", " ", " \n", "\xa0 ", "\r\n\t"])
def test_long_white_space(n, blank):
    """Runs of any length, at the start, in the middle and at the end of a text, have the reference library's ids."""
    import public_tokenizers

    encode = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    run = (blank * n)[:n]
    for text in [run, f"{run}a", f"a{run}", f"a b{run}c, d{run[:300]}9"] if n < 1000 else [f"a{run}b"]:
        assert encode(text) == encode.reference(text)


def test_packing_survives_long_white_space(spark):
    d = spark.createDataFrame([(1, "a" + "\n" * 1_000_000 + "b")], "doc_id bigint, text string")
    rows = packing.pack_documents(d).collect()
    assert sum(r.length for r in rows) == max(r.start + r.length for r in rows) > 1000


def test_best_fit_plan_covers_every_piece_once():
    rng = np.random.default_rng(1)
    hist = {int(n): int(c) for n, c in zip(rng.integers(1, 1025, 300), rng.integers(1, 20, 300), strict=True)}
    plan, bins = packing.plan_best_fit(hist, 1024)
    load, ranks = defaultdict(list), defaultdict(set)
    for n, rank, count, first, offset in plan:
        for i in range(count):
            load[first + i].append((offset, n))
            ranks[n].add(rank + i)
    assert {n: set(range(c)) for n, c in hist.items()} == ranks and len(load) == bins
    for x in load.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:], strict=False)) and sum(x[-1]) <= 1024
    room: list[int] = []  # best fit over single pieces, longest first
    for n in sorted((n for n, c in hist.items() for _ in range(c)), reverse=True):
        fit = min((r for r in room if r >= n), default=None)
        if fit is not None:
            room.remove(fit)
        room.append((1024 if fit is None else fit) - n)
    assert bins == len(room)


def test_sharding(docs, small):
    for d in (docs, small):
        got = sharding.shard_documents(d).collect()
        want = Counter((str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in d.collect())
        assert Counter((str(r.doc_id), r["size"], r.text_crc32) for r in got) == want
        slots = defaultdict(list)
        for r in got:
            assert 0 <= r.shard < 16 and r.law == "bytes" and r.grown_shard is None
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in got)
    assert sharding.shard_documents(docs.filter("doc_id = -1")).count() == 0


def test_shards_hold_the_documents(docs):
    own = [c for c in docs.columns if c != "size"]
    got = sharding.shard_documents(docs).collect()
    assert Counter(repr([r[c] for c in own]) for r in got) == Counter(repr([r[c] for c in own]) for r in docs.collect())
    assert all(r.text_crc32 == zlib.crc32((r.text or "").encode()) for r in got)


def test_packing_query_and_pipeline_keep_ids(spark, docs, sf):
    for d in (queries.op8_best_fit_packing(spark, sf), corpus_pipeline.best_fit_packing(spark, docs, "")):
        assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in d.collect())


def test_sharding_splits_a_group_of_copies(spark):
    d = spark.createDataFrame([(i, "same text" if i % 2 else f"text {i}") for i in range(4000)], "doc_id bigint, text string")
    sizes = Counter()
    for r in sharding.shard_documents(d, part_bytes=1000).collect():
        sizes[r.shard] += r["size"]
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) < 100


def test_mixing(docs, small):
    for d in (docs, small):
        rows = [(r.doc_id, r.source, len((r.text or "").encode().split())) for r in d.collect()]
        size = Counter()
        for _, s, n in rows:
            size[s] += n
        order = sorted(size, key=lambda s: (s is None, s or ""))
        weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
        target, open_, left = {}, set(order), 1.5 * sum(size.values())
        while open_:
            level = left / sum(weight[s] for s in open_)
            full = {s for s in open_ if weight[s] * level >= 2 * size[s]}
            for s in full or open_:
                target[s] = 2.0 * size[s] if full else weight[s] * level
            left -= sum(2 * size[s] for s in full)
            open_ = open_ - full if full else set()
        got = mixing.mix_documents(d).collect()
        assert Counter((str(r.doc_id), r["size"]) for r in got) == Counter((str(i), n) for i, _, n in rows)
        taken, biggest = Counter(), Counter()
        for r in got:
            assert r.taken in (0, r["size"], 2 * r["size"]) and r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6
            taken[r.source] += r.taken
            biggest[r.source] = max(biggest[r.source], r["size"])
        assert all(abs(taken[s] - target[s]) <= biggest[s] for s in order)
        assert sorted(map(str, got)) == sorted(map(str, mixing.mix_documents(d).collect()))
    assert mixing.mix_documents(docs.filter("doc_id = -1")).count() == 0


def test_subset_counts():
    sizes, counts = [0, 3, 7, 50, 1000], [5, 10, 4, 6, 9]
    for budget in (0, 3, 10, 350, 1_050, 9_300):
        take = mixing.subset_counts(sizes, counts, budget)
        total = sum(s * k for s, k in zip(sizes, take, strict=True))
        assert all(0 <= k <= c for k, c in zip(take, counts, strict=True)) and budget - 3 < total <= budget


def test_sharding_spreads_equal_keys(spark):
    """One text without ids, or with one repeated id, is dealt over all shards, though nothing tells its rows apart."""
    for doc_id in ("cast(null as bigint)", "7"):
        d = spark.range(3200).selectExpr(f"{doc_id} AS doc_id", "'the same text' AS text", "id AS _key", "'x' AS _part", "id % 2 AS shard")
        got = sharding.shard_documents(d, part_bytes=2000)
        rows = got.collect()
        assert max(Counter(r.shard for r in rows).values()) <= 215 and got.rdd.getNumPartitions() >= 16
        assert sorted((r._key, r._part) for r in rows) == [(i, "x") for i in range(3200)]
        for n in range(16):
            assert sorted(r.slot for r in rows if r.shard == n) == list(range(sum(r.shard == n for r in rows)))


def test_captures_with_equal_keys_are_split(spark, tmp_path):
    """3,000 captures of one URL with null ids, or with one repeated id and one payload, fall to the stated number of ranges."""
    for ids, html in (("cast(null as bigint)", "concat('page ', id)"), ("5", "'the same page'")):
        d = spark.range(3000).selectExpr(f"{ids} AS page_id", "'http://a.b/c' AS url", f"{html} AS html")
        got = warc.archive_pages(d, rows_per_part=300)
        held = got.groupBy(F.spark_partition_id()).count().collect()
        assert len(held) >= 8 and max(r[1] for r in held) < 700 and sum(r[1] for r in held) == 3000
        rows = got.collect()
        assert {r.record_type for r in rows} == {"response"}
        keys = [(r.urlkey, r.captured_at, r.file, r.position) for r in rows]
        assert keys == sorted(keys)


def test_warc_round_trip(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet").unionByName(spark.createDataFrame([(901, None, None), (900, "http://A.b/x\ny", ""), (902, "::bad", "é" * 50), (None, "http://b.a/", "é" * 50), (903, "http://b.a/", "é" * 50)], "page_id bigint, url string, html string"))
    rows = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    least = {}
    for i, h in rows.items():
        if i is not None:
            least[h] = min(least.get(h, i), i)
    got = warc.archive_pages(pages).collect()
    assert len(got) == pages.count()
    for r in got:
        h = rows[r.page_id]
        assert r.payload_bytes == len(h) and r.payload_digest == base64.b32encode(hashlib.sha1(h).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if least[h] == r.page_id else ("revisit", least[h]))
    keys = [(r.urlkey, r.captured_at) for r in got]
    assert keys == sorted(keys)
    path = f"file://{tmp_path}/w"
    warc.write_warc(pages, path, least=1 << 30)
    back = {r.page_id: r for r in warc.read_warc(spark, path).collect()}
    assert {i: bytes(r.payload) for i, r in back.items()} == rows and all(r.record_type == "response" for r in back.values())
    assert warc.archive_pages(pages.filter("page_id = -1")).count() == 0


def test_archives_of_other_tools(spark, tmp_path):
    """A warcinfo record first, empty and folded header values, a request, bare LF, other digests, and a revisit that names nothing."""
    import gzip

    def record(kind, block, *more, end="\r\n"):
        return gzip.compress(end.join(["WARC/1.0", f"WARC-Type: {kind}", "WARC-Date: 2020-01-01T00:00:00Z", *more, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n")

    http = "Content-Type: application/http; msgtype=response"
    parts = [
        record("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"),
        record("response", b"HTTP/1.1 200 OK\r\nServer:\r\nX: a\r\n b\r\n\r\nbody\r\n\r\nrest", http, "WARC-Target-URI: <http://a.b/x>", "WARC-Payload-Digest: md5:00", "X-Empty:"),
        record("response", b"HTTP/1.1 200 OK\nA: b\n\nlf", http, "WARC-Target-URI: http://a.b/y", end="\n"),
        record("request", b"GET / HTTP/1.1\r\nHost: a.b\r\n\r\n", "Content-Type: application/http; msgtype=request", "WARC-Target-URI: http://a.b/x"),
        record("revisit", b"", "WARC-Target-URI: http://a.b/x"),
    ]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(parts))
    got = [(r.record_type, r.url, bytes(r.payload), r.payload_bytes, r.page_id) for r in warc.read_warc(spark, f"file://{tmp_path}/x.warc.gz").orderBy("position").collect()]
    assert got == [
        ("warcinfo", None, b"software: x\r\n", 13, None),
        ("response", "http://a.b/x", b"body\r\n\r\nrest", 12, None),
        ("response", "http://a.b/y", b"lf", 2, None),
        ("request", "http://a.b/x", b"", 0, None),
        ("revisit", "http://a.b/x", b"", None, None),
    ]


def test_archives_keep_long_pages_and_ignore_other_columns(spark):
    rows = [(1, "http://a/", "x" * 3_000_000, "q", 5), (2, "http://a/", "x" * 3_000_000, "q", 6), (2, "http://a/", "y", "q", 7)]
    d = spark.createDataFrame(rows, "page_id bigint, url string, html string, file string, position int")
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_pages(d).collect())
    assert got == [(1, 3_000_000, "response", None), (2, 1, "response", None), (2, 3_000_000, "revisit", 1)]


def test_a_hot_key_is_tried_in_tiles(spark, monkeypatch):
    """One document outside the key's main component meets every other, in tiles; a hub's edges are dealt over tiles."""
    monkeypatch.setattr(minhash, "TILE", 4)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join([*words[: 250 - i % 3], f"own{i}"]) for i in range(60)] + [" ".join(words[:280])] * 2 + [" ".join(words[40:])]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = [shingles(t) for t in texts]
    want = list(range(len(texts)))
    for _ in texts:
        for i, j in itertools.combinations(range(len(texts)), 2):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                want[i] = want[j] = min(want[i], want[j])
    assert [r.component_id for r in minhash.near_duplicates(d).orderBy("doc_id").collect()] == want
    profiles = minhash.signatures(d, 10).select(minhash.F.col("doc_id").alias("doc"), minhash.F.col("n_shingles").alias("n"), "signature", "bitmap")
    shared = spark.createDataFrame([(int(minhash.chunk_keys(np.frombuffer(r.signature, "<u2")[None])[0, 0]), r.doc) for r in profiles.collect()], "key bigint, doc bigint")
    parts = spark.createDataFrame([(i, 0) for i in range(1, 50)], "node bigint, component bigint")
    got = {(r.a, r.b) for r in minhash.cross_pairs(shared, profiles, parts, 19, 85).collect()}
    comp = {i: 0 if i < 50 else i for i in range(len(texts))}
    by = {r.doc: r for r in profiles.collect()}
    keys = {i: minhash.chunk_keys(np.frombuffer(by[i].signature, "<u2")[None])[0] for i in by}
    for i, j in itertools.combinations(range(len(texts)), 2):
        same = np.flatnonzero(keys[i] == keys[j])
        if comp[i] != comp[j] and len(same) and same[0] == 0 and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
            assert (i, j) in got
    assert all(comp[a] != comp[b] for a, b in got)


def test_loser_tree():
    rng = np.random.default_rng(2)
    for k in range(8):
        runs = [sorted((int(x), i) for x in rng.integers(0, 20, rng.integers(0, 9))) for i in range(k)]
        assert list(warc.LoserTree(runs, lambda r: r)) == sorted(x for r in runs for x in r)


def test_neighbours(spark, sf):
    t = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = t.collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    got = defaultdict(list)
    for r in ann.nearest_neighbours(t).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = np.where(np.arange(len(ids)) == q, -9, x @ x[q])
        hits.append(len({v for v, _ in got[ids[q]]} & set(ids[np.argsort(-s)[:20]].tolist())))
        assert len(got[ids[q]]) == 20 and all(abs(s[np.flatnonzero(ids == v)[0]] - sc) < 1e-12 for v, sc in got[ids[q]])
    assert np.mean(hits) / 20 >= 0.9


def test_neighbours_edge_cases(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [1.0, 1.0]), (6, [2.0, 0.0]), (7, [1.0]), (20, [1.0, 0.0]), (None, [1.0, 0.0])] + [(i, [0.5, 0.5]) for i in range(100, 160)]
    d = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<double>, v string")
    got = defaultdict(list)
    for r in ann.nearest_neighbours(d).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got[0] == [6, 5, 20, *range(100, 117)] and got[20] == [6, 0, 5, *range(100, 117)]
    assert got[100] == [5, 6, 0, 20, *range(101, 117)] and got[140] == [5, 6, 0, 20, *range(100, 116)] and set(got) == {0, 20, 100, 120, 140}
    assert ann.nearest_neighbours(d.filter("vec_id = -1")).count() == 0


@pytest.mark.parametrize("huge", [1e160, 1e300])
def test_neighbours_of_huge_vectors(spark, huge):
    """One finite but huge vector: squares and products overflow, and every query still gets all others."""
    rows = [(0, [1.0, 0.5]), (20, [0.2, 1.0]), (3, [huge, 1.0]), (4, [-huge, 1.0])]
    got = defaultdict(list)
    for r in ann.nearest_neighbours(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got == {0: [(3, huge + 0.5), (20, 0.7), (4, 0.5 - huge)], 20: [(3, 0.2 * huge + 1.0), (0, 0.7), (4, 1.0 - 0.2 * huge)]}


def test_neighbours_count_ids_among_equal_vectors(spark):
    rows = [(1, [1.0, 0.0])] * 30 + [(i, [1.0, 0.0]) for i in (2, 3)] + [(20, [0.5, 0.0])]
    got = ann.nearest_neighbours(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(20, 1), (20, 2), (20, 3)]


def test_neighbours_hold_recall_where_lists_are_fine(spark):
    """Lists this fine stand for a large table: at the least ratio a query reads too small a share."""
    x = np.random.default_rng(4).normal(size=(6000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    t = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>")
    got = defaultdict(set)
    for r in ann.nearest_neighbours(t, list_rows=16, copies=1).collect():
        got[r.query_id].add(r.vec_id)
    hits = []
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -9
        hits.append(len(got[q] & set(np.argsort(-s)[:20].tolist())))
    assert np.mean(hits) / 20 >= 0.92


def test_exact_neighbours(spark):
    x = np.random.default_rng(6).integers(-3, 4, (300, 4)).astype(float)
    t = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, v array<double>").repartition(5)
    got = ann.exact_neighbours(t, [(q, x[q].tolist()) for q in (0, 7, 299)], 20)
    for q in (0, 7, 299):
        assert got[q] == sorted((i for i in range(300) if i != q), key=lambda i: (-(x[i] @ x[q]), i))[:20]


def test_search(docs):
    """Every row counts, repeated ones too: a query's results are compared with its scores over all rows, ids and scores alike."""
    rows = [(r.doc_id, (r.text or "").encode().lower().split()) for r in docs.collect() if r.doc_id is not None]
    n, mean = len(rows), sum(len(w) for _, w in rows) / len(rows)
    df = Counter(t for _, w in rows for t in set(w))
    got = defaultdict(list)
    for r in bm25.search_similar(docs, k=4, every=1).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc_id, r.score))
    for q, words in rows:
        scores = []
        for d, w in rows:
            tf = Counter(w)
            s = sum(math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in set(words) if tf[t])
            if s > 0:
                scores.append((-math.floor(s * 1e6 + 0.5) / 1e6, d))
        want = sorted(scores)[:4]
        assert [d for d, _ in got[q]] == [d for _, d in want] and all(abs(s + t) < 2e-6 for (_, s), (t, _) in zip(got[q], want, strict=True))
    assert bm25.search_similar(docs.filter("doc_id = -1")).count() == 0


def test_blocks_are_skipped_and_results_are_exact():
    """Documents on many topics with some common words: most blocks of frequent terms are never read, and the best are those of brute force."""
    rng = np.random.default_rng(8)
    topic = np.repeat(np.arange(40), 25)
    docs = [np.unique(np.concatenate([rng.choice(60, 12) + 100 * t, rng.choice(8, 3) + 10_000]), return_counts=True) for t in topic]
    terms = np.concatenate([t for t, _ in docs]).astype(np.uint64)
    order = np.argsort(terms, kind="stable")
    first = np.flatnonzero(np.diff(terms[order], prepend=np.uint64(1 << 60)))
    lengths = np.array([c.sum() for _, c in docs])
    row = {"terms": terms[order][first], "starts": np.append(first, len(terms)), "ords": np.repeat(np.arange(1000, dtype=np.int32), [len(t) for t, _ in docs])[order], "tfs": np.concatenate([c for _, c in docs])[order].astype(np.int32), "ids": np.arange(1000), "lengths": lengths}
    shard = bm25.Shard({k: v.tobytes() for k, v in row.items()}, float(lengths.mean()), 1.2, 0.75)
    df = dict(zip(row["terms"].tolist(), np.diff(row["starts"]).tolist(), strict=True))
    for q in range(0, 1000, 50):
        t, _ = docs[q]
        idf = np.array([math.log1p((1000 - df[x] + 0.5) / (df[x] + 0.5)) for x in t.tolist()])
        w = dict(zip(t.tolist(), idf.tolist(), strict=True))
        scores = np.array([sum(w[x] * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * cs.sum() / lengths.mean())) for x, c in zip(ts.tolist(), cs.tolist(), strict=True) if x in w) for ts, cs in docs])
        want = np.lexsort((np.arange(1000), -np.floor(scores * 1e6 + 0.5)))[:10]
        for least in (0.0, float(scores[want[-1]])):
            ids, found = bm25._best(*shard.top(t.astype(np.uint64), idf, 10, least), 10)
            assert ids.tolist() == want.tolist() and np.allclose(found, scores[want])
    assert shard.blocks_skipped > 0 and shard.blocks_read > 0


def test_a_batch_of_queries_is_searched_at_once():
    """Queries in one batch get what brute force finds, also where scores are nearer than single precision tells; blocks are skipped query by query."""
    rng = np.random.default_rng(9)
    n, words = 1500, np.arange(400, dtype=np.uint64)
    tfs = np.where(rng.random((n, 400)) < np.where(np.arange(400) % 3 == (np.arange(n) * 3 // n)[:, None], 0.3, 0.002), rng.integers(1, 4, (n, 400)), 0)
    tfs[1::50] = tfs[::50]  # copies tie
    tfs[2::50] = tfs[::50]
    lengths = tfs.sum(1)
    lengths[2::50] += 10_000
    lengths[3::50], tfs[3::50] = lengths[2::50] + 1, tfs[2::50]  # one word in 10,000 more: nearly the same score
    t, d = np.nonzero(tfs.T)
    row = {"terms": words, "starts": np.append(0, np.cumsum((tfs > 0).sum(0))), "ords": d.astype(np.int32), "tfs": tfs[d, t].astype(np.int32), "ids": np.arange(n), "lengths": lengths}
    mean = float(lengths.mean())
    shard = bm25.Shard({k: v.tobytes() for k, v in row.items()}, mean, 1.2, 0.75)
    idf = np.log1p((n - (tfs > 0).sum(0) + 0.5) / ((tfs > 0).sum(0) + 0.5))
    asked = [np.flatnonzero(tfs[q]) for q in range(0, n, 50)] + [np.zeros(0, np.int64)]
    exact = np.array([(idf * tfs * 2.2 / (tfs + 1.2 * (0.25 + 0.75 * lengths / mean)[:, None]))[:, a].sum(1) for a in asked])
    want = [np.lexsort((np.arange(n), -np.floor(s * 1e6 + 0.5)))[: 10 * bool(s.any())] for s in exact]
    starts = np.append(0, np.cumsum([len(a) for a in asked]))
    for known in (False, True):
        least = np.array([s[w[-1]] if known and len(w) else 0.0 for s, w in zip(exact, want, strict=True)])
        query, ids, scores = bm25._best_of_each(*shard.search(starts, np.concatenate(asked), words, idf, 10, least), 10)
        assert [ids[query == q].tolist() for q in range(len(asked))] == [w.tolist() for w in want]
        assert np.allclose(scores, exact[query, ids], rtol=1e-12)
    assert shard.blocks_skipped > 0 and shard.blocks_read > 0


def test_indexes_stay_out_of_sparks_heap(docs, monkeypatch):
    """Tables that Spark writes have no large columns: Python writes the indexes, every document in one of them."""
    tables = []
    write = bm25.materialize
    monkeypatch.setattr(bm25, "materialize", lambda df, what: tables.append(write(df, what)) or tables[-1])
    assert bm25.search_similar(docs, k=2, every=1).count() > 0
    assert tables and not [t.schema.simpleString() for t in tables if "binary" in t.schema.simpleString()]
    rows = [(r.doc_id, (r.text or "").encode().lower().split()) for r in docs.filter("doc_id is not null").collect()]
    index = bm25.write_index(docs.filter("doc_id is not null").select("doc_id", "text").repartition(3), bm25.work_path(docs.sparkSession, "index")).collect()
    assert len(index) > 1 and sum(r.documents for r in index) == len(rows) and sum(r.words for r in index) == sum(len(w) for _, w in rows)
    read = [bm25._read_index(r.file, ("ids", "lengths", "tfs")) for r in index]
    ids, lengths, tfs = (np.concatenate([np.frombuffer(x[n], kind) for x in read]) for n, kind in (("ids", np.int64), ("lengths", np.int64), ("tfs", np.int32)))
    assert sorted(zip(ids.tolist(), lengths.tolist(), strict=True)) == sorted((i, len(w)) for i, w in rows) and tfs.sum() == lengths.sum()


def test_an_index_in_memory_is_little_larger_than_its_matrices(monkeypatch):
    """Postings of frequent terms aren't held beside their matrices, and a worker keeps no powers for a whole feed of text."""
    rng = np.random.default_rng(10)
    n, words = 4096, 400
    tfs = rng.integers(0, 4, (n, words)) * (rng.random((n, words)) < np.where(np.arange(words) < 300, 0.6, 0.005))
    t, d = np.nonzero(tfs.T)
    row = {"terms": np.arange(words, dtype=np.uint64), "starts": np.append(0, np.cumsum((tfs > 0).sum(0))), "ords": d.astype(np.int32), "tfs": tfs[d, t].astype(np.int32), "ids": np.arange(n), "lengths": tfs.sum(1)}
    row, mean = {k: v.tobytes() for k, v in row.items()}, float(tfs.sum(1).mean())
    tracemalloc.start()
    shard = bm25.Shard(row, mean, 1.2, 0.75)
    held, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    cells = n * shard.block_max.shape[0]  # a byte for the count and four for the weight
    assert len(shard.block_max) == 300 and held < 6 * cells and most < 9 * cells
    monkeypatch.setattr(superkmers, "POWERS", superkmers.Powers())
    texts = [[b"w%d" % (i * i % 5003) for i in range(100_000)], [], [b"w1"], [b"long" * 50_000]]
    terms = bm25._terms(texts)
    assert superkmers.POWERS.up.nbytes < 4 << 20 and [len(x) for x, _ in terms] == [len(set(x)) for x in texts] and [c.sum() for _, c in terms] == [len(x) for x in texts]
    assert terms[2][0][0] == bm25._terms([[b"w1"]])[0][0][0] and terms[2][0][0] in terms[0][0]


def test_every_query_is_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)] and set(queries.SQL) <= set(queries.QUERIES)
