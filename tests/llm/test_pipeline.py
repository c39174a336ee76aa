"""The pipeline's stages, each on what the one before kept, against brute force."""

import itertools
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest

from pyspark.sql import functions as F

from corvane.llm import langid, mixing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Columns that a stage, or the operator behind it, adds to documents under these names.
CLASHING = "_gone _copy score lang_pred kept n_words n_removed _id doc times size source_size target n extra whole rank _text _draw component_id n_shingles key spans _spans LANG_PREDICTED".split()


def words(t):
    return (t or "").encode().split()


def vector(t, letters, table):
    """The bundle of a text's trigrams, letter by letter."""
    s = [0]
    for c in t or "":
        if (x := int(table[ord(c)])) or s[-1]:
            s.append(x)
    s += [0] if s[-1] else []
    v = np.zeros(langid.DIM)
    for a, b, c in zip(s, s[1:], s[2:], strict=False):
        v += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
    return v if v.any() else None


def languages(rows):
    """(prediction, cosine) of each row by brute force."""
    import zlib

    letters = np.random.default_rng(1).choice(np.array([-1, 1], np.float32), (langid.SYMBOLS, langid.DIM)).astype(float)
    table = langid.symbol_table()
    vectors = [vector(r.text, letters, table) for r in rows]
    sums = defaultdict(lambda: np.zeros(langid.DIM))
    for r, v in zip(rows, vectors, strict=True):
        if r.lang is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and v is not None:
            sums[r.lang] += np.rint(v * (10_000 / np.linalg.norm(v)))
    names = sorted(sums)
    matrix = np.array([sums[n] / np.linalg.norm(sums[n]) for n in names])
    out = []
    for v in vectors:
        cosines = matrix @ v / np.linalg.norm(v) if v is not None else np.zeros(1)
        out.append(("und", 0.0) if v is None else (names[int(cosines.argmax())], max(0.0, float(cosines.max()))))
    return out


def after_language_id(rows):
    return Counter((r.doc_id, r.text, r.lang or p, r.source, r.n_chars) for r, (p, s) in zip(rows, languages(rows), strict=True) if p != "und" and (s >= 3 / 512**0.5 or len(words(r.text)) < 10))


def after_near_dedup(rows):
    sets = {}
    for r in rows:
        w = words((r.text or "").lower())
        if r.doc_id is not None and w:
            sets.setdefault(r.doc_id, []).append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))))
    low = {i: i for i in sets}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if any(100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b])]
    for _ in low:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return Counter(tuple(r) for r in rows if low.get(r.doc_id, r.doc_id) == r.doc_id)


def after_substring_dedup(rows):
    key = lambda r: -(1 << 63) if r.doc_id is None else r.doc_id
    first, out = {}, Counter()
    for r in rows:
        w = words(r.text)
        for i in range(len(w) - 19):
            x = tuple(w[i : i + 20])
            first[x] = min(first.get(x, (key(r), i)), (key(r), i))
    for r in rows:
        w = words(r.text)
        gone = {j for i in range(len(w) - 19) if first[tuple(w[i : i + 20])] < (key(r), i) for j in range(i, i + 20)}
        text = b" ".join(x for j, x in enumerate(w) if j not in gone).decode() if gone else r.text
        out[(r.doc_id, text, r.lang, r.source, len(text) if gone else r.n_chars)] += 1
    return out


def check_mix(before, after):
    """Each row not at all, once or twice; each source within one document of its target."""
    size, biggest = Counter(), Counter()
    for r in before:
        size[r.source] += len(words(r.text))
        biggest[r.source] = max(biggest[r.source], len(words(r.text)))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(size.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * size[s]}
        target |= {s: 2.0 * size[s] if full else weight[s] * level for s in full or open_}
        left -= sum(2 * size[s] for s in full)
        open_ = open_ - full if full else set()
    have, taken, mixed = Counter(map(tuple, before)), Counter(map(tuple, after)), Counter()
    assert all(n <= 2 * have[x] for x, n in taken.items())
    for r in after:
        mixed[r.source] += len(words(r.text))
    assert all(abs(mixed[s] - target[s]) <= biggest[s] for s in order)


def check_packing(before, after):
    """Ids as the reference tokenizer gives them; sequences without gaps, no more of them than first-fit decreasing needs."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = Counter()
    for r in before:
        x = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        cut = len(x) % 1024 or 1024
        for s, e in [(0, cut), *((i, i + 1024) for i in range(cut, len(x), 1024))]:
            ids[(r.doc_id, s, tuple(x[s:e]))] += 1
    assert ids == Counter((r.doc_id, r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in after)
    held = defaultdict(list)
    for r in after:
        held[r.sequence_id].append((r.offset, r.length))
    for x in held.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(x)) and sum(x[-1]) <= 1024
    room = []
    for n in sorted((r.length for r in after), reverse=True):
        at = next((i for i, free in enumerate(room) if free >= n), None)
        if at is None:
            room.append(1024 - n)
        else:
            room[at] -= n
    assert len(held) <= len(room)


@pytest.mark.parametrize("which", ["docs", "small", "none"])
def test_stages(spark, docs, small, which, tmp_path):
    """On edge cases, on a table of the tests' data, and on an empty one."""
    d = {"docs": docs, "small": small.filter("doc_id < 90"), "none": docs.limit(0)}[which]
    d = d.select(*COLUMNS, *[F.struct(F.lit(c), "doc_id").alias(c) for c in CLASHING])
    columns, types = d.columns, d.dtypes
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = d.select(*COLUMNS).collect()
        stage(spark, d, "").write.parquet(f"{tmp_path}/{i}")
        d = spark.read.parquet(f"{tmp_path}/{i}")
        after = d.select(*COLUMNS).collect() if i < 4 else d.collect()
        assert (d.columns == columns and d.dtypes == types) == (i < 4)
        if i < 4:
            own = [f"{c}.col1 = '{c}' and {c}.doc_id <=> doc_id" for c in CLASHING]
            assert d.filter(" and ".join(own)).count() == len(after)
        if name in ("language_id", "near_dedup", "substring_dedup"):
            assert Counter(map(tuple, after)) == {"language_id": after_language_id, "near_dedup": after_near_dedup, "substring_dedup": after_substring_dedup}[name](before)
        else:
            (check_mix if name == "source_mix" else check_packing)(before, after)
    assert bool(after) == (which != "none")


def test_language_predictions_are_those_of_brute_force(docs, small):
    for d in (docs, small.filter("doc_id < 90")):
        rows = d.collect()
        want = sorted((str(r.doc_id), p, round(s, 6)) for r, (p, s) in zip(rows, languages(rows), strict=True))
        assert sorted((str(r.doc_id), r.lang_pred, round(r.score, 6)) for r in langid.identify_languages(d).collect()) == want


def test_texts_in_no_known_language_go(spark):
    rows = [(i, " ".join(["the quick brown fox jumps over a lazy dog and runs away"] * 3), "en", "a", 1) for i in range(8)]
    odd = "".join(chr(0x430 + i * 7 % 32) + " " * (i % 5 == 4) for i in range(300))
    d = spark.createDataFrame([*rows, (100, odd, "en", "a", 1), (101, "fox", None, "a", 1), (102, "123 !", None, "a", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    d = d.withColumn("lang", corpus_pipeline.F.when(corpus_pipeline.F.col("doc_id") != 100, corpus_pipeline.F.col("lang")))
    assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, d, "").collect()) == [*range(8), 101]


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 100


def test_source_mix_takes_each_row_as_planned(spark):
    """Null and repeated ids: each row is taken as often as its own plan says, so the words are the planned ones exactly."""
    rows = [(None if i % 2 else i % 6, f"{'w ' * (1 + i % 5)}x{i}", "en", "abc"[i % 3], i) for i in range(120)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got, want = {}, {}
    for r in corpus_pipeline.source_mix(spark, d, "").collect():
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
    for r in mixing.mix_documents(d).collect():
        want[r.source] = want.get(r.source, 0) + r.taken
    assert got == want
