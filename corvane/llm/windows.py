"""Substring dedup over word windows: super-k-mers go to their minimiser's bucket, where sorting counts windows exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .superkmers import Block, Packer, PrefixHash, Runs, Tally, joined_spans, later_ones, mixed, not_alone, ragged, remove_repeats

M = 4
BLOCK = 2 << 20
LONG = 1 << 18  # words of a text that go into one block at most


def word_block(texts: list[tuple[int, int, bytes]]) -> Block:
    """One block of (document, first word, words joined by one space)."""
    data = np.frombuffer(b" ".join(t for _, _, t in texts), np.uint8)
    stop = np.append(np.flatnonzero(data == 32), len(data))
    begin = np.append(0, stop[:-1] + 1)
    words = np.array([t.count(b" ") + 1 for _, _, t in texts])
    return Block(data, mixed(PrefixHash(data)(begin, stop)), begin, stop, np.repeat(np.arange(len(texts)), words), np.cumsum(words), np.array([d for d, _, _ in texts]), np.array([s for _, s, _ in texts]))


def word_blocks(k: int):
    def blocks(batches: Iterator[pa.RecordBatch], packer: Packer | Tally) -> Iterator[None]:
        held, size = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                for i in range(0, max(0, len(words) - k + 1), LONG):
                    held.append((doc, i, b" ".join(words[i : i + LONG + k - 1])))
                    size += len(held[-1][2])
                    if size >= BLOCK:
                        packer.add(word_block(held))
                        held, size = [], 0
                        yield
        if held:
            packer.add(word_block(held))
        yield

    return blocks


def match_words(runs: Runs, begin: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort the windows of all minimisers as strings; all but the earliest of equal ones are returned.

    Windows whose hash no other window has can't equal one and aren't sorted.
    """
    space = np.flatnonzero(runs.data == 32)
    left, right = np.sort(np.append(begin, space + 1)), np.sort(np.append(begin + runs.size, space))
    count = runs.windows.astype(np.int64)
    words = count + k - 1
    at = np.repeat(np.arange(len(count)), count)
    window = ragged(np.zeros(len(count), np.int64), count)
    head = (np.cumsum(words) - words)[at] + window
    lo, hi = left[head], right[head + k - 1]
    pick = not_alone(mixed(PrefixHash(runs.data)(lo, hi)))
    at, window, lo, hi = at[pick], window[pick], lo[pick], hi[pick]
    keys = [runs.data[a:b].tobytes() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
    order = sorted(range(len(keys)), key=keys.__getitem__)
    groups, g = np.zeros(len(keys), np.int64), 0
    for x, y in zip(order, order[1:]):  # noqa: RUF007
        g += keys[x] != keys[y]
        groups[y] = g
    pick = later_ones(groups, runs.doc[at], runs.start[at] + window)
    return at[pick], window[pick]


def cut_words(text: bytes | None, spans: list | None) -> tuple[int, int, str]:
    words = (text or b"").split()
    kept, last, removed = [], 0, 0
    for s, e in joined_spans(spans, len(words)):
        kept += words[last:s]
        removed, last = removed + e - s, e
    kept += words[last:]
    return len(words), removed, b" ".join(kept).decode()


def remove_repeated_windows(docs: DataFrame, k: int = 20, keep_text: bool = True, bucket_bytes: int = 10 << 20) -> DataFrame:
    """Remove every word covered by a window of ``k`` consecutive words that also starts earlier.

    Words are runs of bytes other than space and 0x09-0x0D. Earlier means a smaller doc_id, or an earlier start in the
    same document; windows are judged on the input. The first copy of a passage stays. Null texts count as empty; texts of fewer than
    ``k`` words stay whole; a null doc_id comes before all others; rows with the same doc_id lose the same
    word positions, and none for being equal to each other. An empty table gives an empty result.

    Returns all columns of ``docs`` (the text itself only with ``keep_text``) and n_words, n_removed, kept (the kept words, joined by one space), replacing columns of these names.
    """
    return remove_repeats(docs, k, M, word_blocks(k), match_words, cut_words, "n_words bigint, n_removed bigint, kept string", "windows", keep_text, bucket_bytes)
