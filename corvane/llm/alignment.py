"""Alignment of two tokenizers over the same texts: groups of tokens between common boundaries, and counts of the id pairs that they link."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release_memory
from .packing import Encoder

#: Groups of more links than this have each side's repeated ids merged before their pairs are listed.
SMALL_GROUP = 16
#: A pair that more than this share of all entries hold is joined by broadcast: at most 20,000 pairs can be.
HOT_SHARE = 1 / 20_000
BEST_A, BEST_B = 1, 2


class PlainEncoder(Encoder):
    """Ids of the byte-level vocabulary, where special tokens' strings inside texts are plain text."""

    def __init__(self, vocabulary: str, ranks: str | None):
        super().__init__(vocabulary, ranks)
        self.slow.encode_special_tokens = True

    def token_bytes(self) -> list[bytes]:
        """The bytes of every id: printable Latin-1 characters stand for themselves, the others for code points from 256 on."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        vocab = self.slow.get_vocab()
        out = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            out[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        return out


class PieceEncoder:
    """Ids of a piece vocabulary, which puts a space before the text, and the bytes of every id."""

    def __init__(self, model: str):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=model)

    def __call__(self, text: str) -> list[int]:
        return self.pieces.encode(text)

    def token_bytes(self) -> list[bytes]:
        p = self.pieces
        names = [p.id_to_piece(i) for i in range(p.get_piece_size())]
        return [bytes([int(x[3:5], 16)]) if p.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]


class Side:
    """One tokenizer's ids as bytes, lengths and decimal strings."""

    def __init__(self, encode, inner: str, last: str):
        self.encode, self.bytes = encode, encode.token_bytes()
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.inner = np.array([f"{i}{inner}" for i in range(len(self.bytes))], object)
        self.last = np.array([f"{i}{last}" for i in range(len(self.bytes))], object)

    def ids(self, text: str, whole: bytes) -> np.ndarray | None:
        """The ids of ``text``; None if their joined bytes aren't ``whole``."""
        ids = self.encode(text)
        return np.array(ids, np.int32) if b"".join([self.bytes[i] for i in ids]) == whole else None


def merge_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the tokens of either side that end where one of the other ends: a merge of both ascending lists of ends."""
    at = np.searchsorted(ends_b, ends_a)
    cut_a = np.flatnonzero(ends_b[np.minimum(at, len(ends_b) - 1)] == ends_a) if len(ends_b) else np.zeros(0, np.int64)
    return cut_a, at[cut_a]


def linked_pairs(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, doc_of_group: np.ndarray, bits_b: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes doc << bits | a << bits_b | b of all linked pairs, ascending, and how many links each stands for.

    A group's links are the product of its sides. Products of small groups are listed; in large ones repeated ids are merged first.
    """
    n_a, n_b = np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1)
    first_a, first_b = cut_a - n_a + 1, cut_b - n_b + 1
    small = np.flatnonzero(n_a * n_b <= SMALL_GROUP)
    links = n_a[small] * n_b[small]
    group = np.repeat(small, links)
    nth = np.arange(len(group)) - np.repeat(np.cumsum(links) - links, links)
    x, y = np.divmod(nth, n_b[group])
    codes = (doc_of_group[group] << bits) | (a[first_a[group] + x].astype(np.int64) << bits_b) | b[first_b[group] + y]
    codes.sort()
    starts = np.flatnonzero(np.diff(codes, prepend=-1))
    codes, weights = codes[starts], np.diff(starts, append=len(codes))
    parts = [(codes, weights)]
    for g in np.flatnonzero(n_a * n_b > SMALL_GROUP):
        ids_a, w_a = np.unique(a[first_a[g] : cut_a[g] + 1], return_counts=True)
        ids_b, w_b = np.unique(b[first_b[g] : cut_b[g] + 1], return_counts=True)
        parts.append((((doc_of_group[g] << bits) | (ids_a.astype(np.int64)[:, None] << bits_b) | ids_b).ravel(), (w_a[:, None] * w_b).ravel()))
        if sum(len(c) for c, _ in parts[1:]) > 1 << 22:
            parts = [summed(parts)]
    return summed(parts) if len(parts) > 1 else parts[0]


def summed(parts: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and weights of all parts as one, with the weights of equal codes added."""
    codes, weights = np.concatenate([c for c, _ in parts]), np.concatenate([w for _, w in parts])
    order = np.argsort(codes, kind="stable")
    codes, weights = codes[order], weights[order]
    starts = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[starts], np.add.reduceat(weights, starts) if len(starts) else weights


def packed(values: np.ndarray) -> bytes:
    """Unsigned values in the narrowest of 1, 2, 4 or 8 bytes each, that width first."""
    top = int(values.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


class Aligner:
    """Groups and links of a block of documents."""

    def __init__(self, vocabulary: str, ranks: str | None, model: str):
        self.a, self.b = Side(PlainEncoder(vocabulary, ranks), ",", "|"), Side(PieceEncoder(model), ",", ";")
        self.bits_b = len(self.b.bytes).bit_length()
        self.bits = self.bits_b + len(self.a.bytes).bit_length()

    def __call__(self, texts: Sequence[str | None], keep_groups: bool) -> dict[str, list]:
        """Columns of one row per text; the first row also has the block's distinct pairs and how many of its texts link each."""
        ids_a, ids_b, empty = [], [], np.zeros(0, np.int32)
        for text in texts:
            a = b = None
            if text:
                whole = f" {text}".encode()
                a = self.a.ids(f" {text}", whole)
                b = self.b.ids(text, whole) if a is not None else None
            ids_a.append(empty if b is None else a)
            ids_b.append(empty if b is None else b)
        end_a, end_b = np.cumsum([len(x) for x in ids_a]), np.cumsum([len(x) for x in ids_b])
        a, b = np.concatenate(ids_a), np.concatenate(ids_b)
        cut_a, cut_b = merge_ends(np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b]))
        doc_of_group = np.searchsorted(end_a, cut_a, "right")
        end_group = np.searchsorted(cut_a, end_a)  # how many groups end before the next document
        n_a, n_b = np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1)
        before = np.concatenate([[0], np.cumsum(n_a * n_b)])
        codes, weights = linked_pairs(a, b, cut_a, cut_b, doc_of_group, self.bits_b, self.bits)
        pairs, where = np.unique(codes & ((1 << self.bits) - 1), return_inverse=True)
        end_pair = np.searchsorted(codes >> self.bits, np.arange(len(texts)), "right")

        # a group's tokens stand side by side: those of A come after all tokens of B in earlier groups, and the other way round
        parts = np.empty(len(a) + len(b), object)
        group_a, group_b = np.repeat(np.arange(len(cut_a)), n_a), np.repeat(np.arange(len(cut_b)), n_b)
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[cut_a], last_b[cut_b] = True, True
        parts[np.arange(len(a)) + (cut_b - n_b + 1)[group_a]] = np.where(last_a, self.a.last[a], self.a.inner[a])
        parts[np.arange(len(b)) + (cut_a + 1)[group_b]] = np.where(last_b, self.b.last[b], self.b.inner[b])

        cols: dict[str, list] = {c: [] for c in ("n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256", "pairs", "links", "block_pairs", "block_docs")}
        ga = gb = gg = gp = 0
        for i in range(len(texts)):
            ea, eb, eg, ep = int(end_a[i]), int(end_b[i]), int(end_group[i]), int(end_pair[i])
            groups = "".join(parts[ga + gb : ea + eb].tolist())[:-1]
            row = (ea - ga, eb - gb, eg - gg, int(before[eg] - before[gg]), groups if keep_groups else None, hashlib.sha256(groups.encode()).hexdigest() if groups else "")
            first = (packed(pairs), packed(np.bincount(where, minlength=len(pairs)))) if i == 0 else (None, None)
            for c, v in zip(cols.values(), (*row, packed(where[gp:ep]), packed(weights[gp:ep]), *first), strict=True):
                c.append(v)
            ga, gb, gg, gp = ea, eb, eg, ep
        return cols


BLOCKS = "block bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, groups_sha256 string, pairs binary, links binary, block_pairs binary, block_docs binary"


def align_blocks(docs: DataFrame, vocabulary: str, ranks: str | None, model: str, keep_groups: bool, block_bytes: int = 4 << 20, block_docs: int = 4096) -> DataFrame:
    """Tokenize and merge: one row per document, in blocks of about ``block_bytes`` of text, whose first row lists the block's distinct pairs."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pa.set_memory_pool(pa.system_memory_pool())
        align, nth = Aligner(vocabulary, ranks, model), TaskContext.get().partitionId() << 32
        ids: list = []
        texts: list = []
        held = 0

        def block() -> pd.DataFrame:
            out = pd.DataFrame({"block": nth, "doc_id": pd.array([None if pd.isna(i) else int(i) for i in ids], "Int64"), **align(texts, keep_groups)})
            ids.clear()
            texts.clear()
            release_memory()
            return out

        for frame in frames:
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                ids.append(doc_id)
                texts.append(text)
                held += len(text or "")
                if held >= block_bytes or len(ids) >= block_docs:
                    yield block()
                    nth, held = nth + 1, 0
        if ids:
            yield block()

    return docs.select(F.col("doc_id").cast("bigint").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, BLOCKS)


def block_entries(blocks: DataFrame, bits_b: int) -> DataFrame:
    """(block, nth, a, b, docs): the distinct pairs of each block, numbered in it, with how many of its documents link them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pairs, docs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                codes = unpacked(pairs.as_py())
                cols = (np.full(len(codes), block), np.arange(len(codes), dtype=np.int32), (codes >> bits_b).astype(np.int32), (codes & ((1 << bits_b) - 1)).astype(np.int32), unpacked(docs.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["block", "nth", "a", "b", "docs"])

    return blocks.select("block", "block_pairs", "block_docs").filter("block_pairs is not null").mapInArrow(run, "block bigint, nth int, a int, b int, docs bigint")


def pair_counts(entries: DataFrame) -> DataFrame:
    """(a, b, count, blocks, best): how many documents link each pair, and whether that is the highest count of its A id (bit 1) or its B id (bit 2).

    Blocks are counted before anything is shuffled. There are at most as many maxima as either vocabulary has ids, so they are broadcast.
    """
    counts = materialize(entries.groupBy("a", "b").agg(F.sum("docs").alias("count"), F.count(F.lit(1)).alias("blocks")), "pair-counts")
    for side in ("a", "b"):
        counts = counts.join(F.broadcast(counts.groupBy(side).agg(F.max("count").alias(f"most_{side}"))), side)
    best = F.when(F.col("count") == F.col("most_a"), BEST_A).otherwise(0) + F.when(F.col("count") == F.col("most_b"), BEST_B).otherwise(0)
    return counts.select("a", "b", "count", "blocks", best.alias("best"))


def align_documents(docs: DataFrame, vocabulary: str | None = None, ranks: str | None = None, model: str | None = None, keep_groups: bool = True, block_bytes: int = 4 << 20) -> DataFrame:
    """Align the tokens of a byte-level vocabulary (A, over space+text) and of a piece vocabulary (B, which adds the space) in every document.

    Byte offsets where tokens of both end cut them into groups; all pairs of an A and a B token of a group are links. A pair of ids counts
    the documents, over the whole corpus, that hold it linked. Returns doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of
    their A id, ties included), n_best_b (of their B id), count_sum (over links), groups (``a1,a2|b1;a3|b2``; null if not kept) and groups_sha256 ('' without tokens).

    Texts that are null or empty, or whose tokens don't spell them, have no tokens and zeros. Each row is a document of its own, also with a null or
    repeated doc_id, and repeated rows count each. Other columns are ignored; empty tables stay empty. A text is tokenized whole by one task.

    Documents are worked in blocks of about ``block_bytes``. A block lists each distinct pair once, so that what is counted, and what comes back
    with the corpus-wide count, is one row per block and pair, not one per document and pair; pairs that more than one entry in 20,000 holds are joined by broadcast (at
    most 20,000), all others by a shuffle. The two files of A and the one of B are parameters.
    """
    import public_tokenizers

    if vocabulary is None:
        vocabulary, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    model = model or public_tokenizers.path("piece_bpe_32k.model")
    bits_b = len(PieceEncoder(model).token_bytes()).bit_length()
    blocks = materialize(align_blocks(docs, vocabulary, ranks, model, keep_groups, block_bytes), "aligned")
    entries = block_entries(blocks, bits_b)
    counts = materialize(pair_counts(entries), "pair-best")
    least = (counts.agg(F.sum("blocks")).first()[0] or 0) * HOT_SHARE
    hot = counts.filter(F.col("blocks") > least).select("a", "b", "count", "best", F.lit(True).alias("_hot"))
    joined = entries.join(F.broadcast(hot), ["a", "b"], "left")
    rest = joined.filter("_hot is null").drop("count", "best", "_hot").join(counts.filter(F.col("blocks") <= least), ["a", "b"])
    answers = joined.filter("_hot").select("block", "nth", "count", "best").unionAll(rest.select("block", "nth", "count", "best"))

    def back(left: pa.Table, right: pa.Table) -> pa.Table:
        nth = right.column("nth").to_numpy()
        count, best = np.zeros(len(nth), np.int64), np.zeros(len(nth), np.int64)
        count[nth], best[nth] = right.column("count").to_numpy(), right.column("best").to_numpy()
        found = np.zeros((3, left.num_rows), np.int64)
        for i, (pairs, links) in enumerate(zip(left.column("pairs"), left.column("links"), strict=True)):
            at, w = unpacked(pairs.as_py()), unpacked(links.as_py())
            found[:, i] = w @ (best[at] & BEST_A != 0), w @ (best[at] & BEST_B != 0), w @ count[at]
        out = left.select([*SHOWN[:5], "groups", "groups_sha256"])
        for name, values in zip(SHOWN[5:8], found, strict=True):
            out = out.append_column(name, pa.array(values))
        return out.select(SHOWN)

    rows = blocks.drop("block_pairs", "block_docs").groupBy("block")
    schema = ", ".join(f"{c} {'string' if c.startswith('groups') else 'bigint'}" for c in SHOWN)
    return rows.cogroup(answers.groupBy("block")).applyInArrow(back, schema)


SHOWN = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "n_best_b", "count_sum", "groups", "groups_sha256"]
