"""Substring dedup over bytes by a hash-compared suffix sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .superkmers import BYTE_HASH, Block, Packer, PrefixHash, Runs, Tally, joined_spans, later_ones, minimisers, not_alone, ragged, remove_repeats, same_strings

M = 16
BLOCK = 1 << 20


def byte_block(texts: list[tuple[int, int, bytes]]) -> Block:
    """One block of (document, first byte, bytes)."""
    data = np.frombuffer(b"".join(t for _, _, t in texts), np.uint8)
    sizes = np.array([len(t) for _, _, t in texts])
    place = np.arange(len(data) + 1)
    return Block(data, BYTE_HASH[data], place[:-1], place[1:], np.repeat(np.arange(len(texts), dtype=np.int32), sizes), np.cumsum(sizes), np.array([d for d, _, _ in texts]), np.array([s for _, s, _ in texts]))


def byte_blocks(k: int):
    def blocks(batches: Iterator[pa.RecordBatch], packer: Packer | Tally) -> Iterator[None]:
        held, size = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                for i in range(0, max(0, len(raw) - k + 1), BLOCK):
                    held.append((doc, i, raw[i : i + BLOCK + k - 1]))
                    size += len(held[-1][2])
                    if size >= BLOCK:
                        packer.add(byte_block(held))
                        held, size = [], 0
                        yield
        if held:
            packer.add(byte_block(held))
        yield

    return blocks


class SuffixSorter:
    """Sorts suffixes of a byte array by their first ``k`` bytes, comparing by prefix hashes.

    The common extension of two suffixes is found by binary search over hashes of prefixes, so that a comparison costs at
    most about log2(k) steps; one bottom-up mergesort sorts all groups at once, each element finding its
    rank in the neighbouring run by binary search.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, k: int):
        self.data, self.starts, self.k = data, starts, k
        hashes = PrefixHash(data)
        self.sums, self.base, self.scale = hashes.sums, hashes.sums[starts], hashes.down[starts]
        self.whole = self.prefix(np.arange(len(starts)), k)

    def prefix(self, i: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Hash of the first ``n`` bytes of suffix ``i``."""
        return (self.sums[self.starts[i] + n] - self.base[i]) * self.scale[i]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes ``i`` and ``j``, which differ within ``k`` bytes."""
        n = np.zeros(len(i), np.int64)
        a, b, a_base, b_base, a_scale, b_scale = self.starts[i], self.starts[j], self.base[i], self.base[j], self.scale[i], self.scale[j]
        step = 1 << ((self.k - 1).bit_length() - 1)
        while step:
            end = np.minimum(n + step, self.k)
            n = np.where((self.sums[a + end] - a_base) * a_scale == (self.sums[b + end] - b_base) * b_scale, end, n)
            step >>= 1
        return np.minimum(n, self.k - 1)

    def before(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(suffix i sorts before suffix j, they are equal)."""
        equal = self.whole[i] == self.whole[j]
        less = np.zeros(len(i), bool)
        x = np.flatnonzero(~equal)
        n = self.common(i[x], j[x])
        less[x] = self.data[self.starts[i[x]] + n] < self.data[self.starts[j[x]] + n]
        return less, equal

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes within each group; ``group`` is ascending."""
        n = len(self.starts)
        order = np.arange(n)
        edge = np.flatnonzero(np.diff(group, prepend=group[:1] - 1)) if n else order
        which = np.searchsorted(edge, np.arange(n), "right") - 1
        g_lo, g_hi = edge[which], np.append(edge[1:], n)[which]
        width = 1
        live = np.arange(n)
        while (live := live[g_hi[live] - g_lo[live] > width]).size:
            run = (live - g_lo[live]) // width
            lo = g_lo[live] + run * width
            left = run % 2 == 0
            o_lo = np.minimum(np.where(left, lo + width, lo - width), g_hi[live])
            o_hi = np.where(left, np.minimum(o_lo + width, g_hi[live]), lo)
            x, y, own = o_lo.copy(), o_hi.copy(), order[live]
            go = np.flatnonzero(x < y)
            while go.size:
                mid = (x[go] + y[go]) // 2
                less, equal = self.before(order[mid], own[go])
                ahead = less | (equal & ~left[go])
                x[go] = np.where(ahead, mid + 1, x[go])
                y[go] = np.where(ahead, y[go], mid)
                go = go[x[go] < y[go]]
            merged = order.copy()
            merged[np.where(left, lo, o_lo) + (live - lo) + (x - o_lo)] = own
            order = merged
            width *= 2
        return order


def match_bytes(runs: Runs, begin: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix-sort the windows of each minimiser; all but the earliest of equal windows are returned.

    Windows whose hash over ``k`` bytes no other window has can't equal one and aren't sorted. Equal windows have their minimiser at the same
    place, so windows are sorted in groups of minimiser and place. Neighbours whose hashes agree over ``k`` bytes are compared byte by byte; should two
    differ, their group is sorted anew by its bytes.
    """
    none = np.zeros(0, np.int64)
    at = np.repeat(np.arange(len(runs.value)), runs.windows)
    window = ragged(np.zeros(len(runs.value), np.int64), runs.windows.astype(np.int64))
    starts = begin[at] + window
    pick = not_alone(PrefixHash(runs.data)(starts, starts + k))
    if not len(pick):
        return none, none
    at, window, starts = at[pick], window[pick], starts[pick]
    minimiser = np.concatenate([[0], np.cumsum(runs.value[1:] != runs.value[:-1])])
    group = minimiser[at] * k + minimisers(BYTE_HASH[runs.data], k, M)[0][starts] - starts
    order = np.argsort(group, kind="stable")
    at, window, starts, group = at[order], window[order], starts[order], group[order]
    sorter = SuffixSorter(runs.data, starts, k)
    order = sorter.sort(group)
    equal = (group[1:] == group[:-1]) & (sorter.whole[order[1:]] == sorter.whole[order[:-1]])
    near = np.flatnonzero(equal)
    verified = same_strings(runs.data, starts[order[near]], starts[order[near + 1]], np.full(len(near), k))
    for g in np.unique(group[near[~verified]]):
        span = np.flatnonzero(group == g)  # consecutive, before and after sorting
        text = {i: runs.data[starts[i] : starts[i] + k].tobytes() for i in span.tolist()}
        order[span] = sorted(text, key=text.__getitem__)
        equal[span[:-1]] = [text[x] == text[y] for x, y in zip(order[span[:-1]].tolist(), order[span[1:]].tolist(), strict=True)]
    classes = np.empty(len(order), np.int64)
    classes[order] = np.concatenate([[0], np.cumsum(~equal)])
    pick = later_ones(classes, runs.doc[at], runs.start[at] + window)
    return at[pick], window[pick]


def cut_bytes(text: bytes | None, spans: list | None) -> tuple[int, int, int, bytes]:
    raw = text or b""
    ranges = joined_spans(spans, len(raw))
    kept, last = [], 0
    for s, e in ranges:
        kept.append(raw[last:s])
        last = e
    kept.append(raw[last:])
    return len(raw), sum(e - s for s, e in ranges), len(ranges), b"".join(kept)


def remove_repeated_strings(docs: DataFrame, k: int = 100, keep_text: bool = True, bucket_bytes: int = 10 << 20) -> DataFrame:
    """Remove every byte covered by a ``k``-byte string that also starts earlier.

    Texts count as UTF-8 (null: empty); matches don't cross documents. Earlier means a smaller doc_id, or an earlier start in the same
    document; overlaps count; strings are judged on the input. Texts of fewer than ``k`` bytes stay whole; a null doc_id
    comes before all others; rows with the same doc_id lose the same positions, and none for being equal to each other.
    An empty table gives an empty result.

    Suffixes are sorted where they can match: windows are bucketed by minimiser (see ``superkmers``), windows whose
    minimiser is unique need no sorting, and of identical runs one is sorted.

    Returns all columns of ``docs`` (the text itself only with ``keep_text``) and n_bytes, n_removed, n_spans (maximal removed runs), kept (binary: a cut may split a character), replacing columns of these names.
    """
    return remove_repeats(docs, k, M, byte_blocks(k), match_bytes, cut_bytes, "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary", "suffixes", keep_text, bucket_bytes)
