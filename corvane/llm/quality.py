"""A quality classifier by attention-based multiple-instance learning: a document is a bag of passages, only documents are labelled."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal
from .langid import held_out

#: A passage ends after this many words, or bytes where words are longer than that.
PASSAGE_WORDS, PASSAGE_BYTES = 64, 4096
BUCKETS, HIDDEN, GATES = 256, 32, 16
#: Classes of bytes: lower and upper case, digits, white space, beyond ASCII, and every other ASCII character by itself.
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LOWER = np.arange(256) + 32 * ((np.arange(256) >= 65) & (np.arange(256) <= 90))


def _classes() -> np.ndarray:
    c = np.arange(256)
    known = [(c >= 97) & (c <= 122), (c >= 65) & (c <= 90), (c >= 48) & (c <= 57), SPACE, c >= 128]
    out = np.select(known, range(5), 5)
    other = np.flatnonzero(out == 5)
    out[other] = 5 + np.arange(len(other))
    return out


CLASS = _classes()
KINDS = int(CLASS.max()) + 1
FEATURES = 2 * BUCKETS + 9


def passage_ends(data: np.ndarray) -> np.ndarray:
    """Where the passages of a text end; they follow one another from 0 on. A text without words is one passage."""
    space = SPACE[data]
    words = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    starts = words[::PASSAGE_WORDS].copy()
    starts = starts if len(starts) else np.zeros(1, np.int64)
    starts[0] = 0
    lengths = np.diff(starts, append=len(data))
    parts = np.maximum(1, -(-lengths // PASSAGE_BYTES))
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.append((np.repeat(starts, parts) + nth * PASSAGE_BYTES)[1:], len(data))


def passage_features(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One row per passage: shares (their roots) of hashed byte trigrams and of hashed trigrams of byte classes, shares of the classes, lengths, variety.

    Only bytes of the passage itself count, so a row doesn't depend on what else is in ``data``.
    """
    n, lengths = len(ends), np.diff(ends, prepend=0)
    at = np.repeat(np.arange(n), lengths)
    kind, low = CLASS[data], LOWER[data].astype(np.uint32)
    inside = np.flatnonzero(at[2:] == at[:-2]) if len(data) > 2 else np.zeros(0, np.int64)
    row, out = at[inside] * BUCKETS, np.zeros((n, FEATURES), np.float32)
    grams = low[inside] * np.uint32(0x9E3779B1) + low[inside + 1] * np.uint32(0x85EBCA77) + low[inside + 2] * np.uint32(0xC2B2AE3D)
    shapes = ((kind[inside] * KINDS + kind[inside + 1]) * KINDS + kind[inside + 2]).astype(np.uint32) * np.uint32(0x9E3779B1)
    total = np.maximum(1, lengths - 2)[:, None]
    for i, codes in enumerate((grams, shapes)):
        buckets = (codes ^ codes >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(24)
        out[:, i * BUCKETS : (i + 1) * BUCKETS] = np.sqrt(np.bincount(row + buckets, minlength=n * BUCKETS).reshape(n, BUCKETS) / total)
    each = np.bincount(at * 6 + np.minimum(kind, 5), minlength=n * 6).reshape(n, 6)
    out[:, -9:-3] = each / np.maximum(1, lengths)[:, None]
    space = each[:, 3]
    out[:, -3], out[:, -2] = np.log1p(lengths), np.log1p((lengths - space) / (space + 1))
    out[:, -1] = (out[:, :BUCKETS] > 0).sum(1) / np.minimum(BUCKETS, total[:, 0])
    return out


class AttentionModel:
    """h = tanh(Wx + b) of a passage; its weight is the softmax, over the document, of w (tanh(Vh) * sigmoid(Uh)); the document's logit is c (sum of weighted h) + d."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    @staticmethod
    def started(mean: np.ndarray, std: np.ndarray, seed: int = 1) -> AttentionModel:
        r = np.random.default_rng(seed)
        draw = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        p = {"W": draw(FEATURES, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATES), "U": draw(HIDDEN, GATES), "w": draw(GATES), "c": draw(HIDDEN), "d": np.zeros(1, np.float32)}
        return AttentionModel(p | {"mean": mean, "std": std})

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of passages: what W multiplies, h, and both gates."""
        p = self.p
        x = np.clip((x - p["mean"]) / p["std"], -6, 6)
        h = np.tanh(x @ p["W"] + p["b"])
        return x, h, np.tanh(h @ p["V"]), 1 / (1 + np.exp(-h @ p["U"]))

    def pool(self, h: np.ndarray, t: np.ndarray, s: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Attention of passages, and representation and logit of documents whose passages begin at ``first``."""
        sizes, e = np.diff(first, append=len(h)), (t * s) @ self.p["w"]
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, first), sizes))
        a /= np.repeat(np.add.reduceat(a, first), sizes)
        z = np.add.reduceat(a[:, None] * h, first)
        return a, z, z @ self.p["c"] + self.p["d"]

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss."""
        p = self.p
        x, h, t, s = self.encode(x)
        a, z, logit = self.pool(h, t, s, first)
        sizes = np.diff(first, append=len(h))
        miss = (1 / (1 + np.exp(-logit)) - y) / len(y)
        dz = np.repeat(miss[:, None] * p["c"], sizes, 0)
        da = (dz * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, first), sizes))
        dt, ds = de[:, None] * p["w"] * s * (1 - t * t), de[:, None] * p["w"] * t * s * (1 - s)
        dh = (a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ miss, "d": miss.sum(keepdims=True)}

    def scores(self, docs: Sequence[bytes], most: int = 1 << 20) -> np.ndarray:
        """Of whole texts, ``most`` bytes of passages at a time; between them only what a passage leaves, GATES * 2 + HIDDEN numbers, is held."""
        first, kept, n = [], [], 0
        for x, begins in bags(docs, most):
            first += [n + b for b in begins]
            n += len(x)
            kept.append(self.encode(x)[1:])
        h, t, s = (np.concatenate(c) for c in zip(*kept, strict=True))
        return 1 / (1 + np.exp(-self.pool(h, t, s, np.array(first))[2].astype(np.float64)))


def bags(docs: Sequence[bytes], most: int = 1 << 20) -> Iterator[tuple[np.ndarray, list[int]]]:
    """Features of the passages of all texts in order, and which of these rows begin a text, in pieces of about ``most`` bytes."""
    data: list[np.ndarray] = []
    ends: list[np.ndarray] = []
    begins: list[int] = []
    held = rows = 0

    def piece() -> tuple[np.ndarray, list[int]]:
        out = passage_features(np.concatenate(data), np.concatenate(ends)), begins[:]
        for x in (data, ends, begins):
            x.clear()
        return out

    for doc in docs:
        whole = np.frombuffer(doc, np.uint8)
        cuts, lo, k = passage_ends(whole), 0, 0
        begins.append(rows)
        while k < len(cuts):
            m = max(k + 1, int(np.searchsorted(cuts, lo + most - held, "right")))
            data.append(whole[lo : cuts[m - 1]])
            ends.append(cuts[k:m] - lo + held)
            held, rows, lo, k = held + len(data[-1]), rows + m - k, int(cuts[m - 1]), m
            if held >= most or (k < len(cuts)):
                yield piece()
                held = rows = 0
    if ends:
        yield piece()


def fit_quality(docs: DataFrame, labels: DataFrame, most_documents: int = 8_000, most_passages: int = 32, epochs: int = 12, batch: int = 64, rate: float = 0.003, decay: float = 0.01) -> AttentionModel | float:
    """Learn from labelled documents (``labels``: doc_id, quality 0 or 1) that aren't held out; without both labels the share of 1 (0.5 if none) is the model.

    About ``most_documents`` labelled documents are used, and ``most_passages`` evenly spaced passages of each, chosen by a hash of the id;
    their features (at most 8,000 * 32 * 521 numbers of 16 bits, 267 MB, and 34 MB for documents of four passages) are sorted by id and fitted on the driver with Adam. An id that is
    labelled 0 and 1 is no example; rows that repeat an id are examples each.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("_top")).filter("y = _top").drop("_top")
    counts = dict(known.groupBy("y").count().collect())
    n = sum(counts.values())
    if len(counts) < 2:
        return float(counts.get(1, 0) / n) if n else 0.5
    share = min(1.0, most_documents / n)
    drawn = known.filter(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(12)), F.lit(1 << 30)) < share * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, y, text in zip(*(b.column(i).to_pylist() for i in (0, 1)), b.column(2), strict=True):
                parts = [x for x, _ in bags([text.as_py() or b""])]
                x = np.concatenate(parts)
                x = x[np.linspace(0, len(x) - 1, min(len(x), most_passages)).astype(int)]
                out.append((doc_id, y, x.astype("<f2").tobytes()))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["doc_id", "y", "x"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    found = texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "y", "text").mapInArrow(frugal(run), "doc_id bigint, y int, x binary").collect()
    found = sorted(found, key=lambda r: (r.doc_id, r.x))
    if len({r.y for r in found}) < 2:
        return counts[1] / n
    bag = [np.frombuffer(r.x, "<f2").reshape(-1, FEATURES) for r in found]
    y = np.array([r.y for r in found], np.float32)
    rows = sum(map(len, bag))
    mean = sum(x.sum(0, dtype=np.float64) for x in bag) / rows
    std = np.sqrt(sum(np.square(x - mean).sum(0) for x in bag) / rows)
    model = AttentionModel.started(mean.astype(np.float32), np.maximum(std, 0.01).astype(np.float32))
    first_moment, second_moment, step = {}, {}, 0
    order = np.random.default_rng(2)
    epochs = max(epochs, -(-500 * batch // len(bag)))  # five hundred steps at least
    for _ in range(epochs):
        shuffled = order.permutation(len(bag))
        for at in range(0, len(bag), batch):
            chosen = shuffled[at : at + batch]
            first = np.cumsum([0, *(len(bag[i]) for i in chosen[:-1])])
            step += 1
            for k, g in model.gradients(np.concatenate([bag[i] for i in chosen]).astype(np.float32), first, y[chosen]).items():
                first_moment[k] = 0.9 * first_moment.get(k, 0) + 0.1 * g
                second_moment[k] = 0.999 * second_moment.get(k, 0) + 0.001 * g * g
                move = first_moment[k] / (1 - 0.9**step) / (np.sqrt(second_moment[k] / (1 - 0.999**step)) + 1e-8)
                model.p[k] = (model.p[k] - rate * (move + decay * model.p[k])).astype(np.float32)
    return model


def score_quality(docs: DataFrame, model: AttentionModel | float) -> DataFrame:
    """doc_id and score (0 to 1, to six places; higher: label 1 is likelier) of every document, from its whole text only.

    Null and empty texts, and those without words, are one passage without words. Each row is scored on its own, also with a null or repeated id;
    other columns are ignored; empty tables stay empty. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            scores = [np.full(b.num_rows, model)] if isinstance(model, float) else []
            at = 0
            while at < b.num_rows and not isinstance(model, float):
                group, held = [], 0
                while at < b.num_rows and held < 1 << 20:
                    group.append(texts[at].as_py() or b"")
                    held, at = held + len(group[-1]), at + 1
                scores.append(model.scores(group))
            if b.num_rows:
                yield pa.record_batch([b.column(0), pa.array(np.round(np.concatenate(scores), 6))], names=["doc_id", "score"])

    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return d.mapInArrow(frugal(run), "doc_id bigint, score double")


def judge_quality(docs: DataFrame, labels: DataFrame, most_documents: int = 8_000) -> DataFrame:
    """Learn from the labelled documents that aren't held out, then score all: doc_id, held_out, score, predicted (1 from a score of 0.5 on)."""
    d = score_quality(docs, fit_quality(docs, labels, most_documents))
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
