"""Sharding by histogram sort: exact byte counts refine the splitters, then one exchange of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import int_array, lower_bound_count, materialize, unused_name

#: The key has 63 bits: 35 of the text's hash, then 14 of the id's and 14 of the row's place in the input. Copies of a text are neighbours
#: in key order, yet even a group of copies that holds a third of all rows can be split, also where ids are null or repeat.
ROW_BITS, ID_BITS = 14, 28
KEY_END = 1 << 63


def _key(text, doc_id):
    """Of a row; the place makes it depend on how the input is read, so it is computed once and written."""
    low = lambda h, bits: h.bitwiseAND(F.lit((1 << bits) - 1))
    high = F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 64 - 63 + ID_BITS), ID_BITS)
    ids = F.shiftleft(low(F.xxhash64(doc_id, F.lit(7)), ID_BITS - ROW_BITS), ROW_BITS)
    return high.bitwiseOR(ids).bitwiseOR(low(F.xxhash64(F.monotonically_increasing_id()), ROW_BITS))


def find_splitters(keyed: DataFrame, parts: int, tolerance: float = 0.002, fan: int = 16) -> tuple[list[int], int]:
    """Keys that cut ``keyed(key, size)`` into ``parts`` ranges of nearly equal bytes; and the total.

    Each round counts the bytes below ``fan`` probes in every open bracket in one aggregation, of
    which at most ``parts * fan + 1`` sums reach the driver. A splitter is settled as soon as a
    probe is within ``tolerance`` of an even share, or its bracket holds one row. Probes
    lie between groups of equal texts until a bracket lies inside one group.
    """
    total, rows = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    splitters: dict[int, int] = {}
    state = {j: ((0, 0, 0), (KEY_END - 1, total, rows)) for j in range(1, parts)}
    slack = tolerance * total / parts
    while state:
        probes: set[int] = set()
        for (lo, _, _), (hi, _, _) in state.values():
            step = max(1, (hi - lo) // (fan + 1))
            mask = ~((1 << ID_BITS) - 1) if step >> ID_BITS else -1
            probes.update(p for p in ((lo + i * step) & mask for i in range(1, fan + 1)) if lo < p < hi)
        cuts = sorted(probes)
        sums = {r[0]: (r[1], r[2]) for r in keyed.groupBy(lower_bound_count(F.col("key"), cuts).alias("bin")).agg(F.sum("size"), F.count(F.lit(1))).collect()}
        below, size, count = {}, 0, 0
        for i, cut in enumerate(cuts):
            size, count = size + sums.get(i, (0, 0))[0], count + sums.get(i, (0, 0))[1]
            below[cut] = (cut, size, count)
        for j, (lo, hi) in list(state.items()):
            want = total * j / parts
            for x in (below[c] for c in cuts if lo[0] < c < hi[0]):
                if x[1] <= want:
                    lo = max(lo, x)
                else:
                    hi = min(hi, x)
            near = min(lo, hi, key=lambda x: abs(x[1] - want))
            if abs(near[1] - want) <= slack or hi[2] - lo[2] <= 1 or hi[0] - lo[0] <= 1:
                splitters[j] = near[0]
                del state[j]
            else:
                state[j] = (lo, hi)
    found, last = [], 0
    for j in range(1, parts):
        last = max(last, splitters[j])
        found.append(last)
    return found, total


def shard_documents(docs: DataFrame, shards: int = 16, part_bytes: int = 256 << 20, most_parts: int = 4096) -> DataFrame:
    """Put every document into one of ``shards`` shards of nearly equal UTF-8 bytes.

    Law ``bytes``: a document weighs its text's UTF-8 bytes (null: none) plus 1. Documents are
    ordered by (hash of text, hash of id, hash of place); exact histograms find the cuts; one exchange by key range
    follows. Equal texts share a shard unless a cut must fall inside their group. Each shard consists
    of about ``bytes / part_bytes`` sub-ranges (``most_parts`` in all), each a partition of its own, so that no task
    sorts a whole shard; ``slot`` runs from 0 in each shard, gapless, in key order.

    Returns the documents' own columns (doc_id as bigint), then size, text_crc32 (of the text that was placed; null text: that of the
    empty string), law, shard, slot, grown_shard (null). Columns of these names are replaced. Null ids, ids that repeat, repeated rows and empty tables
    are allowed: each row gets a key and a slot of its own, so many rows with one text and one id, or none, spread too. ``docs`` is read once and written with its keys.
    """
    added = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    docs = docs.drop(*added).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    key, part = unused_name(docs.columns, "_key"), unused_name(docs.columns, "_part")
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + 1).cast("bigint")
    written = materialize(docs.select("*", size.alias("size"), _key(text, F.col("doc_id")).alias(key)), "shard")
    keyed = written.select("size", F.col(key).alias("key"))
    total = keyed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    each = max(1, min(most_parts // shards, -(-total // (shards * part_bytes))))
    cuts, _ = find_splitters(keyed, shards * each)
    counts = dict(keyed.groupBy(lower_bound_count(F.col("key"), cuts).alias("part")).count().collect())
    starts = []
    for p in range(shards * each):
        starts.append(0 if p % each == 0 else starts[-1] + counts.get(p - 1, 0))
    placed = written.withColumn(part, lower_bound_count(F.col(key), cuts)).repartitionById(shards * each, F.col(part)).sortWithinPartitions(key, "doc_id")
    nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the row's place in its partition
    return placed.select(
        *docs.columns,
        "size",
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        (F.col(part) / each).cast("int").alias("shard"),
        (F.get(int_array(starts), F.col(part)) + nth).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
