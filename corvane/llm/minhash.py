"""Near-duplicate documents: b-bit MinHash signatures, a multi-index Hamming join, exact confirmation.

A document is its set of 5-word shingles. Its signature has ``chunks * WIDTH`` components of 16 bits, each
from the least of the set's hashes under one function. If two signatures differ in at most ``2 * chunks - 1``
components, then by pigeonhole some chunk differs in at most one; each chunk is therefore indexed once for every
component left out, and such pairs share a key without exception. Chunks are chosen so that a pair at the
linking similarity exceeds that distance with a probability below 1e-5: 10 for 0.85 (about 6 of 40 differ), 13 for 0.8 (about 10 of 52).

Copies with the same set are one node from the start. Pairs that share a key are settled by exact means only: sizes, then
bitmaps of the sets (an element of A in a bucket that B leaves empty isn't in B), then the full sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, materialize, scratch
from .components import connected_components
from .superkmers import BASE, PrefixHash, mixed

SHINGLE, WIDTH = 5, 4
U8 = np.uint64
_random = np.random.default_rng(20240607)
FACTORS = _random.integers(0, 1 << 63, 256, dtype=U8) * U8(2) + U8(1)
OFFSETS = _random.integers(0, 1 << 63, 256, dtype=U8)
BLOCK = 2 << 20
TILE = 512
PROFILE = "doc bigint, n bigint, signature binary, bitmap binary"


def _sets(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each non-empty word list."""
    data = np.frombuffer(b" ".join(b" ".join(t) for t in texts), np.uint8)
    stop = np.append(np.flatnonzero(data == 32), len(data))
    words = mixed(PrefixHash(data)(np.append(0, stop[:-1] + 1), stop))
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes) - sizes
    h = np.zeros(max(0, len(words) - SHINGLE + 1), U8)
    for i in range(SHINGLE):
        h = h * U8(BASE) + words[i : i + len(h)]
    h = mixed(h)
    out = []
    for b, n in zip(begin.tolist(), sizes.tolist(), strict=True):
        if n >= SHINGLE:
            out.append(np.unique(h[b : b + n - SHINGLE + 1]))
        else:  # the whole sequence is one shingle, unlike any of five words
            x = np.array([n], U8)
            for w in words[b : b + n]:
                x = mixed(x * U8(BASE) + w)
            out.append(x)
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[list[bytes]]]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass").lower()
            ids.append(doc_id)
            texts.append(raw.split())
            size += len(raw)
            if size >= BLOCK:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _bitmap(hashes: np.ndarray) -> bytes:
    """One bit for each of at least 8 buckets per element, a power of two of them."""
    size = 1 << max(6, (8 * len(hashes) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[(hashes & U8(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def signatures(docs: DataFrame, chunks: int) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (hashes of the set), signature, bitmap; the last four null for documents without words."""
    parts_n = chunks * WIDTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _blocks(batches):
            full = [i for i, t in enumerate(texts) if t]
            n = np.zeros(len(ids), np.int64)
            a, b, sig, maps = ([None] * len(ids) for _ in range(4))
            if full:
                sets = _sets([texts[i] for i in full])
                sizes = np.array([len(s) for s in sets])
                flat, begin = np.concatenate(sets), np.cumsum(sizes) - sizes
                least = np.stack([np.minimum.reduceat((flat ^ o) * f, begin) for f, o in zip(FACTORS[:parts_n], OFFSETS, strict=False)], 1)
                parts = (mixed(least) & U8(0xFFFF)).astype("<u2")
                one = np.add.reduceat(mixed(flat), begin).astype(np.int64)
                two = np.add.reduceat(mixed(flat ^ U8(BASE)), begin).astype(np.int64)
                n[full] = sizes
                for j, i in enumerate(full):
                    a[i], b[i], sig[i], maps[i] = int(one[j]), int(two[j]), parts[j].tobytes(), _bitmap(sets[j])
            cols = [pa.array(ids, pa.int64()), pa.array(n), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sig, pa.binary()), pa.array(maps, pa.binary())]
            yield pa.record_batch(cols, names=["doc_id", "n_shingles", "set_a", "set_b", "signature", "bitmap"])

    schema = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, signature binary, bitmap binary"
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(frugal(run), schema)


def chunk_keys(parts: np.ndarray) -> np.ndarray:
    """(rows, chunks * WIDTH) keys of signatures: chunk by chunk, with each component left out once."""
    p = parts.reshape(len(parts), -1, WIDTH).astype(U8)
    keys = np.empty(p.shape, np.int64)
    for out in range(WIDTH):
        h = np.arange(p.shape[1], dtype=U8)[None, :] * U8(WIDTH) + U8(out + 1)
        for i in range(WIDTH):
            if i != out:
                h = mixed(h * U8(BASE) + p[:, :, i])
        keys[:, :, out] = h.astype(np.int64)
    return keys.reshape(len(p), -1)


def index_keys(reps: DataFrame, parts_n: int) -> DataFrame:
    """(key, doc): the index entries of ``reps(doc, signature)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u2").reshape(-1, parts_n)
                docs = np.repeat(part.column(0).to_numpy(), parts_n)
                yield pa.record_batch([pa.array(chunk_keys(sig).ravel()), pa.array(docs)], names=["key", "doc"])

    return reps.select("doc", "signature").mapInArrow(frugal(run), "key bigint, doc bigint")


def _fold(bits: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_or.reduce(bits.reshape(-1, size), 0)


def may_link(n_a: int, n_b: int, map_a: bytes, map_b: bytes, percent: int) -> bool:
    """False only if the two sets can't reach the similarity, judged by sizes and by buckets that only one of them uses."""
    need = percent * (n_a + n_b)
    if (100 + percent) * min(n_a, n_b) < need:
        return False
    size = min(len(map_a), len(map_b))
    a, b = _fold(np.frombuffer(map_a, np.uint8), size), _fold(np.frombuffer(map_b, np.uint8), size)
    common = min(n_a - int(np.bitwise_count(a & ~b).sum()), n_b - int(np.bitwise_count(b & ~a).sum()))
    return (100 + percent) * common >= need


def meet(edges: DataFrame, sides: DataFrame, columns: list[str], test: Callable[[tuple, tuple], bool]) -> DataFrame:
    """Those of ``edges(a, b)`` for which ``test`` holds of the ``columns`` that ``sides(doc, ...)`` has of a and of b.

    The edges of one ``a`` are dealt over tiles of about TILE; a tile gets a's row once, and then b's rows go past it. So a document
    with very many edges is no hot key, and its row isn't sent with every edge.
    """
    tiles = F.coalesce("tiles", F.lit(1))
    many = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).select(F.col("a").alias("_a"), F.ceil(F.col("n") / TILE).alias("tiles"))
    right = edges.join(many.filter("tiles > 1"), F.col("a") == F.col("_a"), "left").select("a", F.pmod(F.xxhash64("b"), tiles).alias("tile"), "b")
    right = right.join(sides, F.col("b") == F.col("doc")).select("a", "tile", F.lit(1).alias("side"), "doc", *columns)
    left = many.select(F.col("_a").alias("a"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)).alias("tile"))
    left = left.join(sides, F.col("a") == F.col("doc")).select("a", "tile", F.lit(0).alias("side"), "doc", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, leads = None, []
        for batch in batches:
            found: tuple[list, list] = ([], [])
            fixed = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            for (a, tile, side, doc), row in zip(fixed, zip(*batch.columns[4:], strict=True), strict=True):
                if (a, tile) != group:
                    group, leads = (a, tile), []
                if not side:
                    leads.append(row)
                elif any(test(x, row) for x in leads):
                    found[0].append(a)
                    found[1].append(doc)
            yield pa.record_batch([pa.array(x, pa.int64()) for x in found], names=["a", "b"])

    return left.union(right).repartition("a", "tile").sortWithinPartitions("a", "tile", "side").mapInArrow(frugal(run), "a bigint, b bigint")


def plausible(edges: DataFrame, profiles: DataFrame, radius: int, percent: int) -> DataFrame:
    """Those of ``edges(a, b)`` within the signature radius that sizes and bitmaps don't rule out."""

    def test(a: tuple, b: tuple) -> bool:
        (n, s, x), (m, t, y) = a, b
        far = int((np.frombuffer(s.as_buffer(), "<u2") != np.frombuffer(t.as_buffer(), "<u2")).sum())
        return far <= radius and may_link(n.as_py(), m.as_py(), x.as_buffer(), y.as_buffer(), percent)

    return meet(edges, profiles, ["n", "signature", "bitmap"], test)


def confirm(edges: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Those of ``edges(a, b)`` whose full shingle sets reach the similarity. The texts of their documents are read again."""
    ids = edges.select(F.col("a").alias("_id")).union(edges.select("b")).distinct()
    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(ids, F.col("doc_id") == F.col("_id"), "left_semi")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts in _blocks(batches):
            full = [i for i, t in enumerate(texts) if t]
            sets = _sets([texts[i] for i in full]) if full else []
            yield pa.record_batch([pa.array([doc_ids[i] for i in full], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc", "items"])

    sets = materialize(chosen.mapInArrow(frugal(shingle), "doc bigint, items binary"), "sets")

    def test(x: tuple, y: tuple) -> bool:
        a, b = np.frombuffer(x[0].as_buffer(), U8), np.frombuffer(y[0].as_buffer(), U8)
        both = np.sort(np.concatenate([a, b]))
        common = int((both[1:] == both[:-1]).sum())
        return (100 + percent) * common >= percent * (len(a) + len(b))

    return meet(edges, sets, ["items"], test)


def _tile_pairs(key: int, rows: list[tuple], radius: int, percent: int) -> tuple[list[int], list[int]]:
    """Plausible pairs of different components in one tile of a key's documents, each reported under the first key it shares.

    ``rows`` are (role, doc, comp, minor, n, signature, bitmap): those of role 0, none of the key's main component, are tried against those of
    role 1; a pair of two of the former is seen from its smaller document only.
    """
    a, b = ([r for r in rows if r[0] == role] for role in (0, 1))
    out: tuple[list[int], list[int]] = ([], [])
    if not a or not b:
        return out
    sig = [np.stack([np.frombuffer(r[5], "<u2") for r in x]) for x in (a, b)]
    doc, comp, minor, n = (np.array([r[i] for r in b]) for i in (1, 2, 3, 4))
    keys = [chunk_keys(s) for s in sig]
    for i, (_, own, own_comp, _, own_n, _, own_map) in enumerate(a):
        js = np.flatnonzero((comp != own_comp) & ~(minor & (doc < own)) & ((100 + percent) * np.minimum(n, own_n) >= percent * (n + own_n)))
        js = js[(sig[1][js] != sig[0][i]).sum(1) <= radius]
        if len(js):
            shared = keys[1][js] == keys[0][i]
            js = js[keys[0][i][shared.argmax(1)] == key]
        for j in js.tolist():
            if may_link(own_n, b[j][4], own_map, b[j][6], percent):
                out[0].append(min(own, b[j][1]))
                out[1].append(max(own, b[j][1]))
    return out


def cross_pairs(shared: DataFrame, profiles: DataFrame, parts: DataFrame, radius: int, percent: int) -> DataFrame:
    """Plausible pairs (a, b) that share a key but not yet a component.

    ``shared(key, doc)`` are the index entries of keys with several documents, ``parts(node, component)`` what is connected so far. Of a key,
    only documents outside its largest component are tried, against all others: both are dealt over tiles of about TILE, and each pair of
    tiles is one small group. So a key with very many documents never meets in one task, and m documents outside the main component
    of n cost about 2 n m / TILE rows.
    """
    d = shared.join(parts, F.col("doc") == F.col("node"), "left").select("key", "doc", F.coalesce("component", "doc").alias("comp"))
    sizes = d.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("rows"))
    main = F.max(F.struct("rows", "comp"))
    per_key = sizes.groupBy("key").agg(main.alias("main"), F.sum("rows").alias("rows"))
    per_key = per_key.filter("main.rows < rows").select(F.col("key").alias("_key"), F.col("main.comp").alias("main"), F.ceil((F.col("rows") - F.col("main.rows")) / TILE).alias("few"), F.ceil(F.col("rows") / TILE).alias("all"))
    d = d.join(per_key, F.col("key") == F.col("_key")).withColumn("minor", F.col("comp") != F.col("main")).withColumn("h", F.xxhash64("doc"))
    d = d.join(profiles.withColumnRenamed("doc", "_doc"), F.col("doc") == F.col("_doc"))
    own = ["doc", "comp", "minor", "n", "signature", "bitmap"]
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    tried = d.filter("minor").select("key", F.pmod("h", "few").alias("i"), every("all").alias("j"), F.lit(0).alias("role"), *own)
    against = d.select("key", every("few").alias("i"), F.pmod("h", "all").alias("j"), F.lit(1).alias("role"), *own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []

        def done():
            a, b = _tile_pairs(group[0], rows, radius, percent)
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(10)]
            for at, this in enumerate(zip(*cols[:3], strict=True)):
                if this != group:
                    if group is not None:
                        yield done()
                    group, rows = this, []
                rows.append(tuple(c[at] for c in cols[3:]))
        if group is not None:
            yield done()

    return tried.union(against).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(frugal(run), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Link documents whose sets of 5-word shingles have 100 * intersection >= ``percent`` * union (80 or more), and form components.

    A-Z is lower-cased; words are runs of bytes other than space and 0x09-0x0D; a document of fewer than five words has its
    whole sequence as one shingle; without words, or with a null text, it has none and stays alone. Every link found
    is confirmed on full sets. A null doc_id stays alone, with a null component; rows with the same doc_id are one document that
    has the links of each. Empty tables give an empty result; other columns are ignored.

    First each key's documents are tried against its smallest one; only keys whose documents remain in different
    components are then searched for further pairs, all of them. Returns doc_id, n_shingles, component_id (the smallest doc_id reachable), kept.
    """
    if percent < 80:
        raise ValueError("signatures are laid out for similarities of 80 % or more")
    chunks = 10 if percent >= 85 else 13
    radius = 2 * chunks - 1
    with scratch(docs.sparkSession) as keep:
        sig = materialize(signatures(docs, chunks), "signatures")
        same_set = ["set_a", "set_b", "n_shingles"]
        kept = F.min_by(F.struct("signature", "bitmap"), "doc_id")  # equal sets have equal signatures, so one row of a class will do
        classes = sig.filter("doc_id is not null and n_shingles > 0").groupBy(*same_set).agg(F.min("doc_id").alias("rep"), kept.alias("_kept"))
        classes = materialize(classes.select("*", "_kept.*").drop("_kept"), "classes")
        profiles = classes.select(F.col("rep").alias("doc"), F.col("n_shingles").alias("n"), "signature", "bitmap")
        keys = index_keys(profiles, chunks * WIDTH)
        several = keys.groupBy("key").agg(F.min("doc").alias("lead"), F.max("doc").alias("_last")).filter("lead <> _last").select(F.col("key").alias("_key"), "lead")
        shared = materialize(keys.join(several, F.col("key") == F.col("_key")).select("key", "doc", "lead"), "shared")
        stars = shared.filter("doc <> lead").select(F.col("lead").alias("a"), F.col("doc").alias("b")).distinct()
        links = materialize(confirm(materialize(plausible(stars, profiles, radius, percent), "pairs"), docs, percent), "confirmed")
        parts = connected_components(links)
        further = materialize(cross_pairs(shared.select("key", "doc"), profiles, parts, radius, percent), "pairs")
        links = links.union(materialize(confirm(further, docs, percent), "confirmed"))
        parts = connected_components(links)
        keep += [sig, classes, parts]
    of_class = classes.join(parts, F.col("rep") == F.col("node"), "left").select(*same_set, F.coalesce("component", "rep").alias("component"))
    worded = sig.filter("doc_id is not null and n_shingles > 0").select("doc_id", *same_set).join(of_class, [*same_set], "left")
    out = worded.drop(*same_set[:2]).unionByName(sig.filter("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles"), allowMissingColumns=True)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
