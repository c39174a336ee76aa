"""Exact repeats of fixed-length windows, found bucket by bucket.

A window is ``k`` consecutive units (bytes or words) of one document. Windows are split into maximal
runs that share their minimiser, the smallest hash among their ``m``-unit strings. Equal windows have equal
minimisers, so a run travels once, as one packed string, to its minimiser's bucket, and a bucket sees all copies of its windows.

A minimiser inside a passage that stands in very many contexts would fill a bucket of its own. Such minimisers are found in a
sample before anything travels, and the windows of their runs are split anew by the minimiser of longer strings; what is
hot even then by still longer ones, and at last by the whole window. All copies of a window take the same way, so this only
deals out the work; results don't depend on the sample.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, materialize

U8 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
MIX = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)
_random = np.random.default_rng(20240501)
#: One random 64-bit number per byte value, for polynomial hashes.
BYTE_HASH = _random.integers(0, 1 << 63, 256, dtype=U8) * U8(2) + U8(1)
NO_ID = -(1 << 63)
SLICE = 1 << 20
SAMPLE = 64 << 20


class Powers:
    """Powers of the base and of its inverse, modulo 2**64, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, U8)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = n + n // 8
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, U8), np.full(size - 1, b, U8)])) for b in (BASE, INVERSE))
        return self.up[:n], self.down[:n]


POWERS = Powers()


class PrefixHash:
    """Prefix polynomial hashes of a byte array; equal substrings have equal hashes."""

    def __init__(self, data: np.ndarray):
        up, self.down = POWERS.get(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U8)
        np.cumsum(BYTE_HASH[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U8(32))) * U8(MIX)
    return x ^ (x >> U8(29))


def string_hashes(units: np.ndarray, m: int) -> np.ndarray:
    """A hash of every ``m``-unit string, put together from those of 1, 2, 4, ... units."""
    h, s, out, done = units, 1, None, 0
    while True:
        if m & s:
            out, done = (h, s) if out is None else (out[: len(out) - s] * U8(pow(MIX, s, 1 << 64)) + h[done:], done + s)
        if done == m:
            return mixed(out)
        h = h[:-s] * U8(pow(BASE, 2 * s + 1, 1 << 64)) + h[s:]
        s *= 2


def minimisers(units: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, value) of the leftmost smallest hash of an ``m``-unit string in every window of ``k`` of at least ``k`` units."""
    h = string_hashes(units, m)
    low, s, w = (h & U8(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U8), 1, k - m + 1
    while 2 * s <= w:
        low = np.minimum(low[:-s], low[s:])
        s *= 2
    if w > s:
        low = np.minimum(low[: len(low) - (w - s)], low[w - s :])
    place = (low & U8(0xFFFFFFFF)).astype(np.int64)
    return place, h[place]


def runs_of(units: np.ndarray, ends: np.ndarray, k: int, m: int):
    """(first window, windows, minimiser, repeats) of each run; ``units`` are hashes, ``ends`` the end of each unit's document.

    ``repeats`` tells that the minimiser occurs twice in the run, without which its windows all differ.
    """
    none = np.zeros(0, np.int64)
    if len(units) < k:
        return none, none, none.astype(U8), none.astype(bool)
    place, value = minimisers(units, k, m)
    valid = np.arange(k, k + len(value)) <= ends[: len(value)]
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (value[1:] != value[:-1])
    first = np.flatnonzero(begins)
    stops = np.append(np.flatnonzero(begins | ~valid), len(value))
    count = stops[np.searchsorted(stops, first, "right")] - first
    return first, count, value[first], place[first] != place[first + count - 1]


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices of all ranges, one after another."""
    begin = np.cumsum(length) - length
    return np.repeat(start - begin, length) + np.arange(int(length.sum()))


@dataclass
class Runs:
    """Runs of windows: minimiser, document, first window, windows, bytes, repeats; and their strings, one after another."""

    value: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    size: np.ndarray
    repeats: np.ndarray
    data: np.ndarray

    TYPES = (U8, np.int64, np.int64, np.int32, np.int32, np.bool_, np.uint8)

    def begins(self) -> np.ndarray:
        return np.cumsum(self.size, dtype=np.int64) - self.size

    def take(self, at: np.ndarray, begin: np.ndarray) -> Runs:
        return Runs(*(getattr(self, f.name)[at] for f in fields(self)[:-1]), self.data[ragged(begin[at], self.size[at].astype(np.int64))])

    def pack(self) -> bytes:
        """Compressed; of the minimiser 40 bits stay, which suffice to group runs (equal strings are told by their bytes)."""
        value = np.ascontiguousarray(self.value.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].T)
        doc = np.diff(self.doc, prepend=0)
        columns = [value, doc, *(getattr(self, f.name).astype(t, copy=False) for f, t in list(zip(fields(self), self.TYPES, strict=True))[2:])]
        return zstandard.compress(b"".join([np.int64(len(self.value)).tobytes(), *(c.tobytes() for c in columns)]), 3)

    @classmethod
    def unpack(cls, blobs: list[bytes]) -> Runs:
        parts: list[list] = [[] for _ in cls.TYPES]
        for blob in blobs:
            raw = zstandard.decompress(blob)
            n, at = int(np.frombuffer(raw, np.int64, 1)[0]), 8
            value = np.zeros((n, 8), np.uint8)
            value[:, :5] = np.frombuffer(raw, np.uint8, 5 * n, at).reshape(5, n).T
            parts[0].append(value.view("<u8").ravel())
            at += 5 * n
            for x, t in list(zip(parts, cls.TYPES, strict=True))[1:]:
                many = n if t is not np.uint8 else len(raw) - at
                x.append(np.frombuffer(raw, t, many, at))
                at += many * np.dtype(t).itemsize
            parts[1][-1] = np.cumsum(parts[1][-1])
        return cls(*(np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(parts, cls.TYPES, strict=True)))


def same_strings(a: np.ndarray, a_start: np.ndarray, b_start: np.ndarray, size: np.ndarray, most: int = 1 << 22) -> np.ndarray:
    """Whether the strings at ``a_start`` and ``b_start`` of array ``a`` are equal, byte by byte."""
    out = np.ones(len(size), bool)
    if not len(size):
        return out
    cut = np.searchsorted(np.cumsum(size, dtype=np.int64), np.arange(most, int(size.sum()) + most, most), "left")
    lo = 0
    for hi in np.unique(np.minimum(cut + 1, len(size))):
        if hi > lo:
            n = size[lo:hi].astype(np.int64)
            equal = a[ragged(a_start[lo:hi].astype(np.int64), n)] == a[ragged(b_start[lo:hi].astype(np.int64), n)]
            out[lo:hi] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
            lo = hi
    return out


def collapse(value, doc, start, size, data, begin, hashes: PrefixHash) -> tuple[np.ndarray, np.ndarray]:
    """(first, copy): for copies of a run's string, the run that starts earliest and whether this one is a later copy.

    Runs count as copies if minimiser, length and hash agree and their bytes do.
    """
    n = len(value)
    key = mixed(hashes(begin, begin + size) + value * U8(BASE) + size.astype(U8))
    order = np.argsort(key, kind="stable")
    again = np.zeros(n, bool)
    again[1:] = key[order][1:] == key[order][:-1]
    group = again.copy()
    group[:-1] |= again[1:]
    some = order[group]
    first = np.arange(n)
    if len(some):
        some = some[np.lexsort((start[some], doc[some], key[some]))]
        fresh = np.ones(len(some), bool)
        fresh[1:] = key[some][1:] != key[some][:-1]
        lead = some[np.maximum.accumulate(np.where(fresh, np.arange(len(some)), 0))]
        same = (size[lead] == size[some]) & (value[lead] == value[some])
        same[same] = same_strings(data, begin[lead[same]], begin[some[same]], size[some[same]])
        first[some[same]] = lead[same]
    return first, first != np.arange(n)


#: (data, begin, runs, k) -> starts of windows that equal one that starts earlier, as (run, window) arrays.
Matcher = Callable[[Runs, np.ndarray, int], tuple[np.ndarray, np.ndarray]]


def spans_of(doc: np.ndarray, start: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Covered ranges (doc, start, end) of windows that start at ``start``; neighbours are joined."""
    if not len(doc):
        return doc, start, start
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + k)
    at = np.flatnonzero(fresh)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], start[at], start[last] + k


def in_groups(values: np.ndarray) -> np.ndarray:
    """Which of the ascending ``values`` occur more than once."""
    again = np.zeros(len(values), bool)
    again[1:] = values[1:] == values[:-1]
    again[:-1] |= again[1:]
    return again


def repeats_in_bucket(runs: Runs, k: int, matcher: Matcher) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ranges covered by windows of this bucket that also start earlier, for some minimisers (about ``SLICE`` bytes of runs) at a time."""
    order = np.argsort(runs.value, kind="stable")
    value = runs.value[order]
    some = in_groups(value) | runs.repeats[order]
    order, value = order[some], value[some]
    begin = runs.begins()
    heads = np.flatnonzero(np.diff(value, prepend=~value[:1])) if len(value) else np.zeros(0, np.int64)
    filled = (np.cumsum(runs.size[order], dtype=np.int64) - runs.size[order])[heads] // SLICE
    cut = heads[np.diff(filled, prepend=-1) > 0]
    for lo, hi in zip(cut, np.append(cut[1:], len(order))[: len(cut)], strict=True):
        yield _repeats_in_slice(runs.take(order[lo:hi], begin), k, matcher)


def _repeats_in_slice(runs: Runs, k: int, matcher: Matcher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first, copy = collapse(runs.value, runs.doc, runs.start, runs.size, runs.data, runs.begins(), PrefixHash(runs.data))
    later = copy & ((runs.doc != runs.doc[first]) | (runs.start != runs.start[first]))
    docs, starts = [np.repeat(runs.doc[later], runs.windows[later])], [ragged(runs.start[later], runs.windows[later].astype(np.int64))]
    left = np.flatnonzero(~copy)
    runs = runs.take(left[in_groups(runs.value[left]) | runs.repeats[left]], runs.begins())
    if len(runs.value):
        at, window = matcher(runs, runs.begins(), k)
        docs.append(runs.doc[at])
        starts.append(runs.start[at] + window)
    return spans_of(np.concatenate(docs), np.concatenate(starts), k)


def not_alone(keys: np.ndarray) -> np.ndarray:
    """Ascending places of the keys that occur more than once."""
    order = np.argsort(keys, kind="stable")
    return np.sort(order[in_groups(keys[order])])


def later_ones(groups: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of items with group numbers, those that don't start earliest in their group."""
    order = np.lexsort((start, doc, groups))
    g, d, s = groups[order], doc[order], start[order]
    fresh = np.ones(len(g), bool)
    fresh[1:] = g[1:] != g[:-1]
    lead = np.maximum.accumulate(np.where(fresh, np.arange(len(g)), 0))
    return order[(d != d[lead]) | (s != s[lead])]


@dataclass
class Block:
    """Some MB of text: the bytes; of each unit its hash, first byte, byte after the last, text and end of the text; of each text its document and the place of its first unit there."""

    data: np.ndarray
    units: np.ndarray
    left: np.ndarray
    right: np.ndarray
    text: np.ndarray
    ends: np.ndarray
    docs: np.ndarray
    bases: np.ndarray


def lengths_of(k: int, m: int) -> list[int]:
    """Units of the strings by which windows are split: ``m`` at first, ``k`` at last."""
    return [m, m + (k - m) * 4 // 7, k - max(1, (k - m) // 21), k]


def split_block(block: Block, k: int, lengths: list[int], hot: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(level, first unit, windows, minimiser, repeats) of all runs; ``hot`` has the ascending hot minimisers of the levels before the last one used."""
    first, count, value, repeats = runs_of(block.units, block.ends[block.text], k, lengths[0])
    for level, (m, burning) in enumerate(zip(lengths[1:], hot, strict=False)):
        at = np.zeros(len(value), bool)
        if len(burning):
            at = burning[np.minimum(np.searchsorted(burning, value), len(burning) - 1)] == value
        yield level, first[~at], count[~at], value[~at], repeats[~at]
        size = count[at] + k - 1
        own = ragged(first[at], size)
        x, count, value, repeats = runs_of(block.units[own], np.repeat(np.cumsum(size), size), k, m)
        first = own[x]
    yield len(hot), first, count, value, repeats


class Packer:
    """Collects the runs of blocks of text by bucket, and packs them once enough is held."""

    def __init__(self, k: int, lengths: list[int], hot: list[np.ndarray], buckets: int, most: int = 20 << 20):
        self.k, self.lengths, self.hot, self.buckets, self.most = k, lengths, hot, buckets, most
        self.held: dict[int, list[Runs]] = {}
        self.burning: list[Runs] = []
        self.spans: list[tuple] = []
        self.bytes = 0

    @property
    def full(self) -> bool:
        return self.bytes >= self.most

    def add(self, block: Block) -> None:
        """Copies within the block are settled here, so a frequent string leaves once per block (one of a hot minimiser: once per pack)."""
        hashes = PrefixHash(block.data)
        for level, first, count, value, repeats in split_block(block, self.k, self.lengths, self.hot):
            if len(first):
                begin, text = block.left[first], block.text[first]
                size = block.right[first + count + self.k - 2] - begin
                start = block.bases[text] + first - np.append(0, block.ends[:-1])[text]
                self._put(level, Runs(value, block.docs[text], start, count, size, repeats, block.data), begin, hashes)

    def _put(self, level: int, runs: Runs, begin: np.ndarray, hashes: PrefixHash) -> None:
        lead, copy = collapse(runs.value, runs.doc, runs.start, runs.size, runs.data, begin, hashes)
        later = copy & ((runs.doc != runs.doc[lead]) | (runs.start != runs.start[lead]))
        if later.any():
            self.spans.append(spans_of(np.repeat(runs.doc[later], runs.windows[later]), ragged(runs.start[later], runs.windows[later].astype(np.int64)), self.k))
        keep = np.flatnonzero(~copy)
        bucket = (runs.value[keep] % U8(self.buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        bucket = bucket[by]
        runs = runs.take(keep[by], begin)
        self.bytes += len(runs.data) + 33 * len(bucket)
        if level > 0:
            self.burning.append(runs)
        else:
            self._deal(runs, bucket)

    def _deal(self, runs: Runs, bucket: np.ndarray) -> None:
        cut = np.flatnonzero(np.diff(bucket, prepend=-1))
        byte = np.append(0, np.cumsum(runs.size))
        for lo, hi in zip(cut, np.append(cut[1:], len(bucket)), strict=True):
            own = [getattr(runs, f.name)[lo:hi].astype(t, copy=False) for f, t in zip(fields(Runs)[:-1], Runs.TYPES[:-1], strict=True)]
            self.held.setdefault(int(bucket[lo]), []).append(Runs(*own, runs.data[byte[lo] : byte[hi]]))

    @staticmethod
    def _joined(parts: list[Runs]) -> Runs:
        return Runs(*(np.concatenate([getattr(p, f.name) for p in parts]) for f in fields(Runs)))

    def flush(self) -> pa.RecordBatch:
        if self.burning:
            runs, self.burning = self._joined(self.burning), []
            self._put(0, runs, runs.begins(), PrefixHash(runs.data))
        rows = [(bucket, False, self._joined(parts).pack()) for bucket, parts in self.held.items()]
        if self.spans:
            doc, start, end = (np.concatenate(x) for x in zip(*self.spans, strict=True))
            home = (mixed(doc.astype(U8)) % U8(self.buckets)).astype(np.int64)
            for b in np.unique(home):
                rows.append((int(b), True, zstandard.compress(np.stack([doc[home == b], start[home == b], end[home == b]]).astype(np.int64).tobytes(), 1)))
        self.held, self.spans, self.bytes = {}, [], 0
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([], [], []), (pa.int64(), pa.bool_(), pa.binary()), strict=True)], names=["bucket", "settled", "blob"])


class Tally:
    """Sums the bytes of the runs of the deepest level by minimiser."""

    most = 1 << 20

    def __init__(self, k: int, lengths: list[int], hot: list[np.ndarray]):
        self.k, self.lengths, self.hot = k, lengths, hot
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    @property
    def full(self) -> bool:
        return sum(map(len, self.values)) >= self.most

    def add(self, block: Block) -> None:
        hashes = None
        for level, first, count, value, repeats in split_block(block, self.k, self.lengths, self.hot):
            if level == len(self.hot) and len(first):
                hashes = hashes or PrefixHash(block.data)
                begin = block.left[first]
                size = block.right[first + count + self.k - 2] - begin
                copy = collapse(value, block.docs[block.text[first]], first, size, block.data, begin, hashes)[1]
                self.values.append(value[~copy])
                self.sizes.append(size[~copy] + 33)

    def flush(self) -> pa.RecordBatch:
        value, at = np.unique(np.concatenate([np.zeros(0, U8), *self.values]), return_inverse=True)
        size = np.bincount(at, np.concatenate([np.zeros(0), *self.sizes]), len(value)).astype(np.int64)
        self.values, self.sizes = [], []
        return pa.record_batch([pa.array(value.view(np.int64)), pa.array(size)], names=["value", "bytes"])


Feed = Callable[[Iterator[pa.RecordBatch], Packer | Tally], Iterator[None]]


def fed(feed: Feed, make: Callable[[], Packer | Tally]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = make()
        for _ in feed(batches, packer):
            if packer.full:
                yield packer.flush()
        yield packer.flush()

    return run


def hot_minimisers(docs: DataFrame, feed: Feed, k: int, lengths: list[int], total: int, most: int) -> list[np.ndarray]:
    """For each level but the last, the ascending minimisers whose runs, by a sample of the texts, take ``most`` bytes or more.

    The sample holds about ``SAMPLE`` bytes of text, or a 2,000th of all if that is more; it only plans how work is dealt out. A hot minimiser takes
    ``most`` of all runs' bytes, of which a text gives some four times its own, so there are at most about 4 ``total`` / ``most``.
    """
    hot: list[np.ndarray] = []
    if 8 * total < most:
        return hot
    share = min(1.0, max(SAMPLE / max(total, 1), 1 / 2000))
    some = docs.sample(False, share, 11) if share < 1 else docs
    while len(hot) < len(lengths) - 1:
        sizes = some.mapInArrow(frugal(fed(feed, lambda h=tuple(hot): Tally(k, lengths, list(h)))), "value bigint, bytes bigint").groupBy("value").agg(F.sum("bytes").alias("bytes"))
        found = sizes.filter(F.col("bytes") >= max(most * share, 8 * 200)).select("value").toArrow().column(0).to_numpy()
        hot.append(np.sort(found.astype(np.int64).view(U8)))
        if not len(found):
            break
    return hot


def find_repeats(docs: DataFrame, k: int, m: int, feed: Feed, matcher: Matcher, bucket_bytes: int = 10 << 20) -> DataFrame:
    """(doc, start, end): unit ranges of ``docs(_id, text)`` covered by windows that also start earlier.

    ``feed(batches, packer)`` adds the blocks of all texts to the packer and yields after each.
    The number of buckets follows the bytes of all texts, so a bucket holds about ``bucket_bytes`` of runs.
    """
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()[0]
    buckets = max(16, min(1 << 20, -(-total * 7 // (2 * bucket_bytes))))
    parts = min(20_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets // 4))
    lengths = lengths_of(k, m)
    docs = docs.select("_id", "text")
    hot = hot_minimisers(docs, feed, k, lengths, total, max(bucket_bytes, total * 7 // (2 * buckets)) // 4)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held, settled):
            spans = repeats_in_bucket(Runs.unpack(held), k, matcher) if held else ()
            for x in itertools.chain((np.frombuffer(zstandard.decompress(x), np.int64).reshape(3, -1) for x in settled), spans):
                yield pa.record_batch([pa.array(c) for c in x], names=["doc", "start", "end"])

        held, settled, current = [], [], None
        for batch in batches:
            for bucket, over, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if bucket != current and current is not None:
                    yield from done(held, settled)
                    held, settled = [], []
                current = bucket
                (settled if over else held).append(blob.as_py())
        if current is not None:
            yield from done(held, settled)

    packed = docs.mapInArrow(frugal(fed(feed, lambda: Packer(k, lengths, hot, buckets))), "bucket bigint, settled boolean, blob binary")
    return packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(frugal(settle), "doc bigint, start bigint, end bigint")


def unused(columns: list[str], name: str) -> str:
    """``name``, or with underscores before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = "_" + name
    return name


def joined_spans(spans: list | None, n: int) -> list[tuple[int, int]]:
    """Maximal removed ranges, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["start"], x["end"]) for x in spans or ()):
        e = min(e, n)
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        elif s < e:
            out.append((s, e))
    return out


def remove_repeats(docs: DataFrame, k: int, m: int, feed: Feed, matcher: Matcher, cut: Callable[[bytes | None, list | None], tuple], more: str, what: str, keep_text: bool, bucket_bytes: int) -> DataFrame:
    """All columns of ``docs`` (``text`` only with ``keep_text``) and those that ``cut(text, spans)`` makes of each text; ``more`` is their schema."""
    names = [x.split(" ")[0] for x in more.split(", ")]
    docs = docs.drop(*names)
    text, doc_id = (next(c for c in docs.columns if c.lower() == x) for x in ("text", "doc_id"))
    own_id = unused(docs.columns, "_id")
    docs = docs.withColumn(text, F.col(text).cast("string")).withColumn(own_id, F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)))
    spans = materialize(find_repeats(docs.select(F.col(own_id).alias("_id"), F.col(text).alias("text")), k, m, feed, matcher, bucket_bytes), what)
    at = docs.columns.index(text)

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zipper = zstandard.ZstdCompressor(3)
        for batch in batches:
            packed = [None if t is None else zipper.compress(t) for t in batch.column(at).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    small = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == text else f.dataType) for f in docs.schema])
    schema = T.StructType([f for f in docs.schema if f.name != own_id and (keep_text or f.name != text)])
    for f in docs.sparkSession.createDataFrame([], more).schema:
        schema = schema.add(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
        for whole in batches:
            for i in range(0, whole.num_rows, 2000):
                batch = whole.slice(i, 2000)
                texts = [None if z is None else zstandard.decompress(z) for z in batch.column(at).to_pylist()]
                rows = [cut(t, s.as_py()) for t, s in zip(texts, batch.column(batch.num_columns - 1), strict=True)]
                arrays = [pa.array(c, kinds[f.split(" ")[1]]) for c, f in zip(zip(*rows, strict=True), more.split(", "), strict=True)]
                own = {n: c for n, c in zip(batch.schema.names[:-1], batch.columns[:-1], strict=True) if n != text}
                if keep_text:
                    own[text] = pa.array(texts, pa.binary()).cast(pa.string())
                kept = [n for n in batch.schema.names[:-1] if n in own]
                yield pa.RecordBatch.from_arrays([own[n] for n in kept] + arrays, names=[*kept, *names])

    span_doc, span_list = unused(docs.columns, "_span_doc"), unused(docs.columns, "_spans")
    by = spans.groupBy(F.col("doc").alias(span_doc)).agg(F.collect_list(F.struct("start", "end")).alias(span_list))
    return docs.mapInArrow(frugal(shrink), small).join(by, F.col(own_id) == F.col(span_doc), "left").drop(span_doc, own_id).mapInArrow(frugal(run), schema)
