"""Language identification by hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frugal

#: Symbols: 0 for anything but a letter, 1-26 for a-z, the rest shared by all other letters by hash.
SYMBOLS = 64
DIM = 512
TABLE_ROWS = 1 << 15


@cache
def symbol_table() -> np.ndarray:
    """The symbol of every code point; upper and lower case share one."""
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = ord(c.lower()[0])
            table[cp] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 >> 7) % (SYMBOLS - 27)
    return table


class Profiler:
    """Vectors of texts: letter vectors, permuted by place and bound into trigrams, bundled over the text."""

    def __init__(self, seed: int = 1):
        letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (SYMBOLS, DIM))
        self.bound = [np.roll(letters, 2, 1), np.roll(letters, 1, 1), letters]
        self.row = np.full(SYMBOLS**3, -1, np.int32)
        self.table, self.filled = np.zeros((1024, DIM), np.float32), 0

    def _bind(self, grams: np.ndarray) -> np.ndarray:
        return self.bound[0][grams >> 12] * self.bound[1][grams >> 6 & 63] * self.bound[2][grams & 63]

    def _vectors(self, grams: np.ndarray) -> np.ndarray:
        """Trigram vectors, kept for up to TABLE_ROWS trigrams and else bound anew."""
        new = grams[self.row[grams] < 0]
        if len(new) and self.filled + len(new) <= TABLE_ROWS:
            while self.filled + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.row[new] = np.arange(self.filled, self.filled + len(new))
            self.table[self.filled : self.filled + len(new)] = self._bind(new)
            self.filled += len(new)
        rows = self.row[grams]
        if (rows >= 0).all():
            return self.table[rows]
        return self._bind(grams)

    def __call__(self, text: str | None, chunk: int = 1 << 20) -> np.ndarray | None:
        """The bundled vector of the whole text (sums of integers, exact in any order); None without letters."""
        total, tail = None, np.zeros(1, np.uint8)
        for i in range(0, len(text or ""), chunk):
            cps = np.frombuffer(text[i : i + chunk].encode("utf-32-le", "surrogatepass"), "<u4")
            s = np.concatenate([tail, symbol_table()[cps], np.zeros(int(i + chunk >= len(text)), np.uint8)])
            s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])].astype(np.int32)
            tail = s[-2:].astype(np.uint8)
            grams, counts = np.unique((s[:-2] << 12) + (s[1:-1] << 6) + s[2:], return_counts=True)
            for j in range(0, len(grams), 4096):
                part = counts[j : j + 4096].astype(np.float32) @ self._vectors(grams[j : j + 4096])
                total = part.astype(np.float64) if total is None else total + part
        return total if total is not None and total.any() else None


def held_out(doc_id: Column) -> Column:
    """Documents kept from learning: crc32 of the id's text leaves 1 when divided by 3."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit_prototypes(docs: DataFrame, most_per_language: int = 20_000) -> dict[str, np.ndarray]:
    """Unit prototypes of all languages in ``lang``, learned from documents that aren't held out.

    Of a language with more, about ``most_per_language`` documents are used, chosen by a hash of their ids. Document
    vectors of unit length are rounded to integers before they are summed, so the sums don't depend on
    order. A task returns one vector per language; one vector per language reaches the driver.
    """
    train = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    train = train.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r[0]: r[1] for r in train.groupBy("lang").count().collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, most_per_language / n))])
    drawn = train.filter(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profile, sums = Profiler(), {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if (v := profile(text.as_py())) is not None:
                    sums[lang] = sums.get(lang, 0) + np.rint(v * (10_000 / np.linalg.norm(v))).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "v": pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))})

    summed = drawn.select("text", "lang").mapInArrow(frugal(run), "lang string, v array<bigint>").select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.sum("col").alias("x"))
    found: dict[str, np.ndarray] = {}
    for lang, pos, x in summed.collect():
        found.setdefault(lang, np.zeros(DIM))[pos] = x
    return {k: v / n for k, v in sorted(found.items()) if (n := np.linalg.norm(v))}


def predict_language(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """All columns of ``docs`` plus lang_pred and score (columns of these names are replaced).

    The prediction is the language whose prototype has the largest cosine with the whole text's vector, ties to the
    smaller name; score is that cosine, at least 0. Texts that are null or have no letter, and all texts if there
    are no prototypes, get ``und`` and 0. Only ``text`` is looked at.
    """
    docs = docs.drop("lang_pred", "score")
    names, matrix = list(prototypes), np.array(list(prototypes.values())).reshape(-1, DIM)
    where = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profile = Profiler()
        for batch in batches:
            found = []
            for text in batch.column(where):
                v = profile(text.as_py()) if names else None
                if v is None:
                    found.append(("und", 0.0))
                else:
                    cosines = matrix @ v / np.linalg.norm(v)
                    best = int(np.argmax(cosines))
                    found.append((names[best], float(min(1.0, max(0.0, cosines[best])))))
            cols = [*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "lang_pred", "score"])

    schema = docs.schema.add("lang_pred", "string").add("score", "double")
    return docs.withColumn(docs.columns[where], F.col(docs.columns[where]).cast("string")).mapInArrow(frugal(run), schema)


def identify_languages(docs: DataFrame, most_per_language: int = 20_000) -> DataFrame:
    """Learn from the labelled documents that aren't held out, then predict all: doc_id, held_out, lang_pred, score."""
    prototypes = fit_prototypes(docs, most_per_language)
    d = predict_language(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), prototypes)
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
