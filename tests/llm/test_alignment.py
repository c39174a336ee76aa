"""Token alignment against a word-for-word two-pointer merge."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from corvane.llm import alignment

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def brute():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    bytes_a = alignment.PlainEncoder(P.path("byte_bpe_50k.json"), None).token_bytes()

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def run(texts):
        rows, links = [], []
        for text in texts:
            ids_a = a.encode(f" {text}", add_special_tokens=False).ids if text else []
            ids_b = b.encode(text) if text else []
            if not text or b"".join(bytes_a[i] for i in ids_a) != f" {text}".encode() or b"".join(map(bytes_b, ids_b)) != f" {text}".encode():
                ids_a = ids_b = []
            groups, j, at_a, at_b, left, right = [], 0, 0, 0, [], []
            for i in ids_a:
                left.append(i)
                at_a += len(bytes_a[i])
                while at_b < at_a:
                    right.append(ids_b[j])
                    at_b += len(bytes_b(ids_b[j]))
                    j += 1
                if at_a == at_b:
                    groups.append((left, right))
                    left, right = [], []
            links.append(Counter((x, y) for g in groups for x in g[0] for y in g[1]))
            shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            rows.append((len(ids_a), len(ids_b), len(groups), sum(links[-1].values()), shown))
        count = Counter(p for found in links for p in found)
        most_a, most_b = defaultdict(int), defaultdict(int)
        for (x, y), n in count.items():
            most_a[x], most_b[y] = max(most_a[x], n), max(most_b[y], n)
        return [
            (*r[:4], sum(w for p, w in found.items() if count[p] == most_a[p[0]]), sum(w for p, w in found.items() if count[p] == most_b[p[1]]), sum(w * count[p] for p, w in found.items()), r[4], hashlib.sha256(r[4].encode()).hexdigest() if r[4] else "")
            for r, found in zip(rows, links, strict=True)
        ]

    return run


RND = random.Random(1)
ODD = [None, "", " ", "a▁b", "<|endoftext|> x <s>", "漢字 ünï ☃ 🎉", "a" * 3000, "".join(RND.choice("abcdefghijklmnop0123456789") for _ in range(3000)), "\n" * 50, "\x00\x01z", "  lead and trail  ", "<0x41>"]


@pytest.mark.parametrize("hot, block", [(1 / 20_000, 4 << 20), (1 / 50, 20_000)])
def test_alignment_is_the_brute_force(spark, small, brute, monkeypatch, hot, block):
    """Once with one block a task, once with many blocks and pairs that are joined by broadcast."""
    monkeypatch.setattr(alignment, "HOT_SHARE", hot)
    texts = [r.text for r in small.select("text").collect()] + ODD + ODD[5:8]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in alignment.align_documents(d, block_bytes=block).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_alignment_edge_cases(spark, docs, brute):
    """Null and repeated ids, repeated rows and clashing names; a row is a document."""
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in alignment.align_documents(docs).collect()), key=repr)
    assert got == sorted(((i, *r) for (i, _), r in zip(rows, brute([t for _, t in rows]), strict=True)), key=repr)
    empty = alignment.align_documents(docs.limit(0))
    assert empty.count() == 0 and empty.columns == alignment.SHOWN


def test_large_groups_keep_every_link():
    """A group's links are its sides' product, also where repeated ids are merged and where pairs are merged in between."""
    import numpy as np

    rnd = np.random.default_rng(2)
    a, b = rnd.integers(0, 3000, 6000).astype(np.int32), rnd.integers(0, 2500, 5000).astype(np.int32)
    cut_a, cut_b = np.array([2999, 3000, 5999]), np.array([2499, 2500, 4999])
    codes, weights = alignment.linked_pairs(a, b, cut_a, cut_b, np.array([0, 0, 1]), 12, 24)
    want = Counter()
    for doc, x, y in ((0, a[:3000], b[:2500]), (0, a[3000:3001], b[2500:2501]), (1, a[3001:], b[2501:])):
        for (i, n), (j, m) in ((p, q) for p in Counter(x.tolist()).items() for q in Counter(y.tolist()).items()):
            want[doc << 24 | i << 12 | j] += n * m
    assert dict(zip(codes.tolist(), weights.tolist(), strict=True)) == want and (np.diff(codes) > 0).all()


def test_packed_values():
    import numpy as np

    for top in (0, 255, 256, 70_000, 1 << 40):
        v = np.array([0, top, 1])
        assert (alignment.unpacked(alignment.packed(v)) == v).all()
    assert not len(alignment.unpacked(alignment.packed(np.zeros(0, np.int64))))
