"""The quality classifier: its features and gradients against plain forms, whole texts in pieces, and held-out accuracy."""

import zlib

import numpy as np
import pytest

from corvane.llm import quality as Q
from corvane.llm.queries import op12_attention_quality


def test_passages_cover_the_text():
    for text in (b"", b"  ", b"a", b" a b", b"w " * 64, b"w " * 65, b"x" * 9000, b"x" * 9000 + b" y" * 100, "é ".encode() * 130):
        ends = Q.passage_ends(np.frombuffer(text, np.uint8)).tolist()
        assert ends[-1] == len(text) and ends == sorted(ends) and max(np.diff([0, *ends])) <= max(Q.PASSAGE_BYTES, 64 * 3)
        parts = [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        assert b"".join(parts) == text and all(len(p.split()) <= Q.PASSAGE_WORDS for p in parts)
        if max(map(len, text.split()), default=0) < 50:
            assert [w for p in parts for w in p.split()] == text.split()


def test_features_don_t_depend_on_neighbours():
    texts = [b"Some Words, 12 %%", b"", b"x", b"more words \xc3\xa9 of another text", b"yz" * 3000]
    together = np.concatenate([x for x, _ in Q.bags(texts)])
    assert np.array_equal(together, np.concatenate([np.concatenate([x for x, _ in Q.bags([t])]) for t in texts]))
    assert together[0, -9:-3] == pytest.approx(np.array([7, 2, 2, 3, 0, 3]) / 17)


def test_pieces_change_no_score():
    model = Q.AttentionModel.started(np.zeros(Q.FEATURES, np.float32), np.ones(Q.FEATURES, np.float32))
    texts = [b"alpha beta " * 700, b"", b"one", b"z" * 20_000, b"gamma, delta. " * 90]
    whole = model.scores(texts)
    assert np.allclose(whole, model.scores(texts, most=500), atol=1e-6)
    assert np.allclose(whole, [model.scores([t])[0] for t in texts], atol=1e-6)


def test_gradients():
    model = Q.AttentionModel.started(np.zeros(Q.FEATURES), np.ones(Q.FEATURES))
    model.p = {k: v.astype(float) for k, v in model.p.items()}
    x, first, y = np.random.default_rng(0).random((7, Q.FEATURES)), np.array([0, 2, 6]), np.array([1.0, 0, 1])

    def loss():
        logit = model.pool(*model.encode(x)[1:], first)[2]
        return np.mean(np.log1p(np.exp(-logit)) * y + np.log1p(np.exp(logit)) * (1 - y))

    for k, g in model.gradients(x, first, y).items():
        at = tuple(s // 2 for s in g.shape)
        kept = model.p[k][at]
        model.p[k][at] = kept + 1e-6
        up = loss()
        model.p[k][at] = kept - 1e-6
        down = loss()
        model.p[k][at] = kept
        assert g[at] == pytest.approx((up - down) / 2e-6, abs=1e-7), k


def test_held_out_accuracy(spark):
    """Learned from about 300 documents; none of the held-out labels is read."""
    sf = "/root/testdata/sf0.01"
    rows = op12_attention_quality(spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert sum(a == b for a, b in held) >= 0.97 * len(held) and sum(a == b == 0 for a, b in held) >= 0.9 * sum(b == 0 for _, b in held)


def test_attention_finds_the_bad_passage():
    """One passage of noise in a long document is found, though only documents are labelled."""
    rnd = np.random.default_rng(3)
    clean = lambda n: [bytes(rnd.choice(list(b"etaoins"), 6).tolist()) for _ in range(64 * n)]
    noise = lambda n: [b"$$%&" + bytes(rnd.choice(list(b"#*!"), 4).tolist()) for _ in range(64 * n)]
    docs = [(b" ".join(clean(10)), 1.0) for _ in range(60)] + [(b" ".join(clean(5) + noise(1) + clean(4)), 0.0) for _ in range(60)]
    bag = [np.concatenate([x for x, _ in Q.bags([t])]) for t, _ in docs]
    x, first, y = np.concatenate(bag), np.cumsum([0, *(len(b) for b in bag[:-1])]), np.array([v for _, v in docs])
    model = Q.AttentionModel.started(x.mean(0), np.maximum(x.std(0), 0.01))
    for _ in range(150):
        for k, g in model.gradients(x, first, y).items():
            model.p[k] = model.p[k] - 0.3 * g
    a = model.pool(*model.encode(bag[-1])[1:], np.array([0]))[0]
    assert a.argmax() == 5 and ((model.scores([t for t, _ in docs]) >= 0.5) == (y == 1)).all()


def test_edge_cases(spark, docs):
    """Null, repeated ids and texts, clashing names, no labels, one label, contradicting and null labels, empty tables."""
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string, score string")
    for rows, score in (([], 0.5), ([(8, 1, 0, "", ""), (7, None, 0, "", ""), (None, 0, 0, "", "")], 1.0), ([(12, 0, 0, "", ""), (12, 1, 0, "", ""), (11, 3, 0, "", "")], 0.5)):
        got = Q.judge_quality(docs.withColumn("score", docs.kept), labels(rows)).collect()
        assert len(got) == docs.count() and {r.score for r in got} == {score}
    both = labels([(i, int(i < 12), 0, "", "") for i in (3, 5, 7, 8, 9, 11, 12, 13, 14, 15, 16, 17, 18, 19)])
    got = Q.judge_quality(docs, both).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (3, 5)}) == 1 and len({r.score for r in got if r.doc_id == 16}) == 1
    assert len({r.score for r in got if r.doc_id == 8}) == 1 and not any(r.held_out for r in got if r.doc_id is None)
    assert Q.judge_quality(docs.limit(0), both).count() == 0 and Q.judge_quality(docs.limit(0), both).columns == ["doc_id", "held_out", "score", "predicted"]
