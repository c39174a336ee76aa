"""Periodic runs of words (maximal repetitions), found through Lyndon words, and texts collapsed to one period of each."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

#: Prefix hashes are polynomials in BASE modulo the Mersenne prime 2**61 - 1.
MODULUS = (1 << 61) - 1
BASE = 1_000_003_141_592_653
#: Common extensions up to this many words are compared word by word, without hashes.
DIRECT = 8


class Extensions:
    """Longest common extensions of two places of a word sequence, by binary search over prefix hashes.

    What the hashes call equal is compared word by word before it is believed, and hashes that differ prove a difference, so results are exact.
    ``proved`` remembers for each distance the stretch whose words are known to equal those that far to their right, and a search
    starts from there, so that in a periodic text no word is compared again for every place of a run.
    """

    def __init__(self, ids: Sequence[int]):
        self.w, self.n = ids, len(ids)
        self.sums: list[int] | None = None
        self.powers: list[int] = []
        self.proved: dict[int, tuple[int, int]] = {}

    def _same(self, i: int, j: int, length: int) -> bool:
        if self.sums is None:
            self.sums, self.powers, h, p = [0], [1], 0, 1
            for x in self.w:
                h = (h * BASE + x + 1) % MODULUS
                p = p * BASE % MODULUS
                self.sums.append(h)
                self.powers.append(p)
        s, p = self.sums, self.powers[length]
        return (s[i + length] - s[i] * p - s[j + length] + s[j] * p) % MODULUS == 0

    def _prove(self, lo: int, hi: int, d: int) -> bool:
        """Whether w[k] == w[k + d] for all lo <= k < hi."""
        w = self.w
        a, b = self.proved.get(d, (lo, lo))
        if hi < a or b < lo:
            a = b = lo
        if (lo < a and w[lo:a] != w[lo + d : a + d]) or (b < hi and w[b:hi] != w[b + d : hi + d]):
            return False
        self.proved[d] = (min(a, lo), max(b, hi))
        return True

    def right(self, i: int, j: int) -> int:
        """How many words from ``i`` on equal those from ``j`` on (i < j)."""
        w, most, k = self.w, self.n - j, 0
        near = min(most, DIRECT)
        while k < near and w[i + k] == w[j + k]:
            k += 1
        if k < near or k == most:
            return k
        a, b = self.proved.get(j - i, (0, 0))
        lo, hi = b - i if a <= i + k < b else k, most
        if lo < most and w[i + lo] != w[j + lo]:
            hi = lo
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self._same(i, j, mid) else (lo, mid - 1)
        if self._prove(i, i + lo, j - i):
            return lo
        return next(k for k in range(lo) if w[i + k] != w[j + k])

    def left(self, i: int, j: int) -> int:
        """How many words before ``i`` equal those before ``j`` (i < j)."""
        w, most, k = self.w, i, 0
        near = min(most, DIRECT)
        while k < near and w[i - 1 - k] == w[j - 1 - k]:
            k += 1
        if k < near or k == most:
            return k
        a, b = self.proved.get(j - i, (0, 0))
        lo, hi = i - a if a < i - k <= b else k, most
        if lo < most and w[i - 1 - lo] != w[j - 1 - lo]:
            hi = lo
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self._same(i - mid, j - mid, mid) else (lo, mid - 1)
        if self._prove(i - lo, i, j - i):
            return lo
        return next(k for k in range(lo) if w[i - 1 - k] != w[j - 1 - k])


def find_runs(words: Sequence, least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal repetition of ``least`` words or more and two periods or more, by start, then period.

    The longest Lyndon word that starts at a place ends where the next smaller suffix starts. Scanning from the right, those links form a stack whose top is
    skipped while its suffix is larger. Every run has, under the order of the words or under its reverse, a period that is such a Lyndon word;
    extended both ways as far as its words repeat it gives the run. The end of the text is smaller than any word under the first order, larger under the second.
    """
    seen: dict = {}
    ids = [seen.setdefault(w, len(seen)) for w in words]
    n, found, lce = len(ids), set(), Extensions(ids)
    for order, end_is_smaller in ((ids, True), ([-x for x in ids], False)):
        smaller = [n] * n  # where the next smaller suffix starts
        for i in range(n - 1, -1, -1):
            x, j, same = order[i], i + 1, 0
            while j < n:
                y = order[j]
                if y < x:
                    same = 0
                    break
                if y == x:
                    same = lce.right(i, j)
                    if end_is_smaller if j + same == n else order[j + same] < order[i + same]:
                        break
                j = smaller[j]
            else:
                same = 0
            smaller[i] = j
            if j == n and not end_is_smaller:
                continue  # the Lyndon word would hold the end mark
            before = lce.left(i, j) if i and order[i - 1] == order[j - 1] else 0
            period = j - i
            if before + period + same >= max(least, 2 * period):
                found.add((i - before, before + period + same, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: Sequence[bytes], runs: Sequence[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    keep = bytearray(b"\1") * len(words)
    for start, length, period in runs:
        keep[start + period : start + length] = bytes(length - period)
    return b" ".join([w for w, k in zip(words, keep, strict=True) if k])


def collapse_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period; by start, then period) and collapsed (text) of every document.

    Words are what ASCII white space separates. A run is a stretch of ``least`` words or more that repeats its smallest period at least twice and can't be
    extended; a word is dropped from ``collapsed`` if any run holds it after that run's first period. Null, empty and blank texts have no words, no
    runs and an empty collapsed text. Null and repeated ids and repeated rows are rows of their own; other columns are ignored; empty tables stay
    empty. Each text is worked whole by one task, in time n log n and memory in proportion to its words; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or b"").split()
                runs = find_runs(words, least)
                kept = collapse(words, runs)
                rows.append((doc_id, len(words), [dict(zip(RUN.names, r, strict=True)) for r in runs], kept.decode()))
                held += len(kept) + 200 * len(runs) + 100
                if held > 1 << 22:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    d = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").cast("binary"))
    return d.mapInArrow(frugal(run), "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` in which every document whose h = crc32(decimal doc_id) is divisible by 10 repeats a stretch of its own words.

    With g = floor(h / 10) and n words, words from a = g % n on become the p = 1 + floor((n - a) / (3 + g % 8)) words from ``a`` on, again and
    again; the words of such a text are joined by one space. Other texts, those without words, and rows with a null doc_id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("bigint").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words).cast("bigint")
    g = F.floor(h / 10)
    a = F.pmod(g, F.greatest(n, F.lit(1)))
    p = 1 + F.floor((n - a) / (3 + g % 8))
    start, left = (a + 1).cast("int"), (n - a).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice(words, start, p.cast("int")), F.ceil((n - a) / p).cast("int"))), F.lit(1), left)
    planted = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), again), " ")
    return docs.withColumn("text", F.when((h % 10 == 0) & (n > 0), planted).otherwise(F.col("text")))


def run_digests(collapsed: DataFrame) -> DataFrame:
    """Of ``collapse_runs``: doc_id, n_runs, the longest run (ties: smallest start, then period), and SHA-256 of all runs and of the collapsed text."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    d = collapsed.withColumn("_best", best)
    return d.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("_best.start")).alias("start"),
        F.col("_best.length").alias("length"),
        (-F.col("_best.period")).alias("period"),
        F.floor(1000 * F.col("_best.length") / -F.col("_best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
