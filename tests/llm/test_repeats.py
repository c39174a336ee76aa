"""Substring dedup by words (super-k-mers) and by bytes (suffix sort), against brute force."""

import hashlib
import random

import numpy as np
import pytest

from corvane.llm import suffixes, superkmers, windows


def brute(rows, k, split):
    """Removed positions by row, judged on (doc_id, start) order; null ids first."""
    key = lambda d: superkmers.NO_ID if d is None else d
    first, out = {}, []
    for d, t in rows:
        u = split(t)
        for i in range(len(u) - k + 1):
            w = tuple(u[i : i + k])
            first[w] = min(first.get(w, (key(d), i)), (key(d), i))
    for d, t in rows:
        u = split(t)
        gone = set()
        for i in range(len(u) - k + 1):
            if first[tuple(u[i : i + k])] < (key(d), i):
                gone |= set(range(i, i + k))
        out.append((d, len(u), gone, u))
    return out


def words(t):
    return (t or "").encode().split()


def raw(t):
    return list((t or "").encode())


@pytest.mark.parametrize("which", ["docs", "small"])
def test_windows(which, request):
    d = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    want = sorted((str(i), n, len(g), b" ".join(w for j, w in enumerate(u) if j not in g).decode()) for i, n, g, u in brute(rows, 20, words))
    got = windows.remove_repeated_windows(d)
    assert set(d.columns) <= set(got.columns)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got.collect()) == want


@pytest.mark.parametrize("which", ["docs", "small"])
def test_suffixes(which, request):
    d = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in d.filter("doc_id < 120 or doc_id is null").select("doc_id", "text").collect()]
    want = wanted_bytes(rows)
    got = suffixes.remove_repeated_strings(d.filter("doc_id < 120 or doc_id is null"), keep_text=False)
    assert found_bytes(got) == want


def wanted_bytes(rows):
    return sorted((str(i), n, len(g), len([x for x in g if x - 1 not in g]), hashlib.sha256(bytes(x for j, x in enumerate(u) if j not in g)).hexdigest()) for i, n, g, u in brute(rows, 100, raw))


def found_bytes(got):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got.collect())


def passages(n, seed):
    """Texts that share passages shorter than, as long as, and longer than a window, in ever new contexts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    shared = [" ".join(word() for _ in range(w)) for w in (12, 15, 19, 21, 40)]
    return [(i, " ".join([*(word() for _ in range(rng.randrange(3, 25))), shared[i % 5], *(word() for _ in range(rng.randrange(3, 25))), *([shared[(i + 1) % 5]] if i % 3 else [])])) for i in range(n)]


def test_hot_passages(spark, monkeypatch):
    """Minimisers that are hot at every level (here: by small buckets) don't change the result, and all levels are used."""
    rows = passages(600, 3)
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    seen = []
    real = superkmers.hot_minimisers
    monkeypatch.setattr(superkmers, "hot_minimisers", lambda *a: seen.append(real(*a)) or seen[-1])
    want = sorted((str(i), n, len(g), b" ".join(w for j, w in enumerate(u) if j not in g).decode()) for i, n, g, u in brute(rows, 20, words))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in windows.remove_repeated_windows(d, bucket_bytes=8000).collect()) == want
    assert found_bytes(suffixes.remove_repeated_strings(d, bucket_bytes=8000)) == wanted_bytes(rows)
    assert [len(x) for x in seen] == [3, 3] and all(len(level) for x in seen for level in x)


def test_one_passage_in_many_contexts():
    """30,000 contexts of one 60-byte passage, all in one bucket: sorted in slices, and exactly."""
    rng = random.Random(5)
    line = bytes(rng.randrange(97, 123) for _ in range(60))
    texts = [bytes(rng.randrange(97, 123) for _ in range(70)) + line + bytes(rng.randrange(97, 123) for _ in range(70)) for _ in range(30_000)]
    texts[20_000] = texts[7]
    held = []
    packer = superkmers.Packer(100, superkmers.lengths_of(100, 16), [], 1)
    for i in range(0, len(texts), 5000):
        packer.add(suffixes.byte_block([(i + j, 0, t) for j, t in enumerate(texts[i : i + 5000])]))
        held += [b.as_py() for b, over in zip(packer.flush().column(2), range(1), strict=True)]
    gone = np.concatenate([np.stack(x, 1) for x in superkmers.repeats_in_bucket(superkmers.Runs.unpack(held), 100, suffixes.match_bytes)])
    assert set(gone[:, 0].tolist()) == {20_000} and superkmers.joined_spans([{"start": s, "end": e} for _, s, e in gone.tolist()], 200) == [(0, 200)]


def test_own_columns_stay(spark):
    d = spark.createDataFrame([(1, "a b", 7, 8, 9)], "doc_id int, text string, _id int, _spans int, _span_doc int")
    got = windows.remove_repeated_windows(d).collect()[0]
    assert (got._id, got._spans, got._span_doc, got.kept) == (7, 8, 9, "a b")


@pytest.mark.parametrize("m", [1, 2, 3, 7, 16, 19, 20])
def test_string_hashes(m):
    units = np.random.default_rng(m).integers(0, 3, 200).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = superkmers.string_hashes(units, m)
    text = [units[i : i + m].tobytes() for i in range(201 - m)]
    assert len(h) == len(text) and len(set(zip(text, h.tolist(), strict=True))) == len(set(text)) == len(set(h.tolist()))


def test_empty(docs):
    none = docs.filter("doc_id = -1")
    assert windows.remove_repeated_windows(none).count() == 0
    assert suffixes.remove_repeated_strings(none).count() == 0


def test_suffix_sort_matches_byte_order():
    rng = random.Random(4)
    data = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(3000)), np.uint8)
    starts = np.arange(2800)
    group = np.sort(np.array([rng.randrange(40) for _ in starts]))
    order = suffixes.SuffixSorter(data, starts, 100).sort(group)
    text = [data[s : s + 100].tobytes() for s in starts]
    for g in range(40):
        span = np.flatnonzero(group == g)
        assert [text[i] for i in order[span]] == sorted(text[i] for i in span)


def test_hash_collisions_are_verified(monkeypatch):
    """With a hash that takes all strings for equal, bytes still decide."""
    data = np.frombuffer((b"abcdefgh" * 40 + b"X") * 2 + b"abcdefgh" * 40, np.uint8)
    runs = superkmers.Runs(np.zeros(3, np.uint64), np.arange(3), np.zeros(3, np.int64), np.array([3, 3, 3]), np.array([102, 102, 102]), np.zeros(3, bool), np.concatenate([data[:102], data[1:103], data[:102]]))
    begin = np.array([0, 102, 204])
    want = set(zip(*(x.tolist() for x in suffixes.match_bytes(runs, begin, 100)), strict=True))
    monkeypatch.setattr(superkmers, "BYTE_HASH", np.zeros(256, np.uint64))
    monkeypatch.setattr(suffixes, "BYTE_HASH", superkmers.BYTE_HASH)
    assert set(zip(*(x.tolist() for x in suffixes.match_bytes(runs, begin, 100)), strict=True)) == want and {(2, 0), (2, 1), (2, 2)} <= want
