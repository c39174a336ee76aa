"""Best-fit packing planned on a histogram of lengths."""

from __future__ import annotations

import base64
import heapq
import re
from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal, materialize

SPECIAL = "<|endoftext|>"
#: Up to here both tokenizer libraries class characters alike; other texts take the slower, reference library.
PLAIN_BELOW = "ɐ"


#: Runs of white space of this length or more (the Latin range's white space) are encoded on their own.
LONG_BLANK = re.compile(r"[\t-\r \x85\xa0]{256,}(?=[^\t-\r \x85\xa0])|[\t-\r \x85\xa0]{256,}\Z")


class Encoder:
    """Token ids of the byte-level vocabulary, as the ``tokenizers`` library gives them.

    Texts of Latin characters without the special token's string go through ``tiktoken`` over the same
    vocabulary, which gives the same ids about four times as fast; all others through ``tokenizers``.

    ``tiktoken`` finds the end of a run of white space by backtracking, and a very long run exhausts its stack. A run before other text is
    always split before its last character, and one at the end not at all, so cutting the text there changes no id:
    long runs are cut out and merged by ``tokenizers``, which takes one as a whole.
    """

    def __init__(self, vocabulary: str, ranks: str | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(vocabulary)
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def reference(self, text: str) -> list[int]:
        return self.slow.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> list[int]:
        if not self.fast or max(text, default="") >= PLAIN_BELOW or SPECIAL in text:
            return self.reference(text)
        out, last = [], 0
        for run in LONG_BLANK.finditer(text):
            end = run.end() - (run.end() < len(text))
            out += self.fast.encode_ordinary(text[last : run.start()])
            out += self.reference(text[run.start() : end])
            last = end
        return out + self.fast.encode_ordinary(text[last:])


def cuts(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: one if it fits; else full pieces after a first, maybe shorter, one."""
    if n <= most:
        return [(0, n)]
    first = n % most or most
    return [(0, first)] + [(s, most) for s in range(first, n, most)]


def tokenize_pieces(docs: DataFrame, most: int = 1024, end_id: int = 2, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit) of every document (null text: only ``end_id``).

    ``part`` is the number of the task that made the piece, ``nth`` counts the task's pieces of the same length from 0.
    """
    import public_tokenizers

    if vocabulary is None:
        vocabulary, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(vocabulary, ranks)
        part, seen = TaskContext.get().partitionId(), [0] * (most + 1)
        out: list[list] = [[], [], [], [], [], [], []]
        held = 0

        def flush():
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
            batch = pa.record_batch([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids", "part", "nth"])
            for x in out:
                x.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                for piece, (start, length) in enumerate(cuts(len(ids), most)):
                    for x, v in zip(out, (doc_id, piece, start, length, ids[start : start + length].tobytes(), part, seen[length]), strict=True):
                        x.append(v)
                    seen[length] += 1
                held += len(ids)
                if held > 1 << 21:
                    held = 0
                    yield flush()
        yield flush()

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(frugal(run), "doc_id bigint, piece int, start bigint, length bigint, ids binary, part int, nth bigint")


def plan_best_fit(histogram: Mapping[int, int], most: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over counts: (length, first rank, count, first sequence, offset) rows, and the number of sequences.

    Pieces of ``length`` whose ranks are ``first rank + i`` (i < count) go to sequence ``first sequence + i``
    at ``offset``. Sequences with the same room form ranges; a step places a whole range, or all
    that is left of a length, so the plan's size depends on the number of lengths only.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}  # room: ranges (first, count) of sequences
    open_rooms: list[int] = []
    plan, opened = [], 0

    def put(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in rooms:
                rooms[room] = []
                insort(open_rooms, room)
            heapq.heappush(rooms[room], (first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left and (i := bisect_left(open_rooms, length)) < len(open_rooms):
            room = open_rooms[i]
            first, count = heapq.heappop(rooms[room])
            if not rooms[room]:
                del rooms[room], open_rooms[i]
            used = min(count, left)
            plan.append((length, rank, used, first, most - room))
            rank, left = rank + used, left - used
            put(room, first + used, count - used)
            put(room - length, first, used)
        per = most // length
        whole, odd = divmod(left, per)
        for k in range(per if whole else 0):
            plan.append((length, rank + k * whole, whole, opened, k * length))
        put(most - per * length, opened, whole)
        rank, opened = rank + per * whole, opened + whole
        for k in range(odd):
            plan.append((length, rank + k, 1, opened, k * length))
        if odd:
            put(most - odd * length, opened, 1)
            opened += 1
    return plan, opened


def pack_pieces(pieces: DataFrame, most: int = 1024, broadcast_rows: int = 500_000) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (length <= most, part, nth, ...), filling few sequences.

    ``pieces`` is read twice; pass a written table. Only the histogram of lengths, at most ``most`` rows, reaches the
    driver; each piece takes the slot that the plan has for its rank among the pieces of its length. Its rank is ``nth`` plus the number of
    such pieces in parts before its own, so pieces needn't move: the table of these numbers, at most ``most`` rows for each part, is
    broadcast if it has no more than ``broadcast_rows`` (some 12 MB) and joined by a shuffle if it has.
    """
    spark = pieces.sparkSession
    counts = materialize(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("_count")), "piece-counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_count")).collect()}
    plan, _ = plan_best_fit(histogram, most)
    by: dict[int, list] = {}
    for length, rank, count, first, offset in plan:
        by.setdefault(length, []).append((rank, first, offset))
    slots = spark.createDataFrame([(n, sorted(x)) for n, x in by.items()], "length bigint, _slots array<struct<rank:bigint,first:bigint,offset:bigint>>")
    slots = F.broadcast(slots) if len(plan) <= 100_000 else slots  # some MB at most; beyond, Spark decides
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_base"))
    bases = F.broadcast(bases) if counts.count() <= broadcast_rows else bases
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("_base") + F.col("nth"))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(map(len, by.values()), default=1).bit_length()))])
    at = F.aggregate(steps, F.lit(0), lambda p, s: F.when((p + s <= F.size("_slots")) & (F.get("_slots", p + s - 1)["rank"] <= F.col("rank")), p + s).otherwise(p))
    d = ranked.join(slots, "length").withColumn("_slot", F.get("_slots", at - 1))
    d = d.withColumn("sequence_id", F.col("_slot.first") + F.col("rank") - F.col("_slot.rank")).withColumn("offset", F.col("_slot.offset"))
    return d.select(*[c for c in pieces.columns if c not in ("part", "nth")], "sequence_id", "offset")


def pack_documents(docs: DataFrame, most: int = 1024, keep_ids: bool = True) -> DataFrame:
    """Tokenize and pack all documents; ``ids_crc32`` is that of the ids' little-endian 32-bit bytes.

    Returns doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset. Null or empty texts give
    one piece of the end id. Rows with the same id are packed each on its own. Other columns are ignored.
    """
    pieces = tokenize_pieces(docs, most)
    if not keep_ids:
        return pack_pieces(materialize(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces"), most)
    packed = pack_pieces(materialize(pieces, "pieces"), most)
    return packed.select("doc_id", "piece", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
