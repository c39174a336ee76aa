"""Exact BM25 top-k search over an inverted index, with block-max dynamic pruning, shard by shard."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal, materialize, release_memory, work_path
from .superkmers import PrefixHash, mixed, ragged

U8 = np.uint64
BLOCK_DOCS = 256
FEED = 2 << 20
WORDS = 1 << 15  # hashed at once; a worker keeps 16 bytes for each of their bytes
QUERIES = 256  # in a batch
CELLS = 16 << 20  # of a shard's frequent terms and documents at most
SUMS = 2 << 20  # of queries and documents at most that are held at once
#: Scores are compared after rounding to six places; pruning leaves this much room for it.
SLACK = 2e-6
INDEX = "terms binary, starts binary, ords binary, tfs binary, ids binary, lengths binary"
MANIFEST = "file string, documents bigint, words bigint"
#: A batch of queries: their ids, starts of their terms, places of these among the batch's distinct terms (ascending), those with their idf, and a score
#: that each query's k-th best reaches.
BATCH = "ids binary, starts binary, places binary, terms binary, idf binary, least binary"


def _names(schema: str) -> list[str]:
    return [x.split(" ")[0] for x in schema.split(", ")]


def _order(starts: np.ndarray, ords: np.ndarray, lengths: np.ndarray, groups: int = 8, rounds: int = 6) -> np.ndarray:
    """Documents ordered by k-means over the commonest terms and by length, so that a block's maxima fit all of it."""
    size = np.diff(starts)
    common = np.argsort(-size, kind="stable")[: min(128, CELLS // max(1, len(lengths)))]
    x = np.zeros((len(lengths), len(common)), np.float32)
    for i, t in enumerate(common):
        x[ords[starts[t] : starts[t + 1]], i] = np.log1p(len(lengths) / size[t])
    norm = np.linalg.norm(x, axis=1)
    x /= np.where(norm > 0, norm, 1)[:, None]
    some = np.flatnonzero(norm)
    if not len(some):
        return np.argsort(lengths, kind="stable")
    centres = x[some[np.linspace(0, len(some) - 1, groups).astype(int)]]
    for _ in range(rounds):
        group = (x @ centres.T).argmax(1)
        for g in range(groups):
            centre = x[group == g].sum(0)
            centres[g] = centre / max(float(np.linalg.norm(centre)), 1e-9)
    return np.lexsort((lengths, group))


def _terms(texts: list[list[bytes]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct term hashes, ascending; how often each occurs) of each word list."""
    full = [t for t in texts if t]
    out: list[tuple[np.ndarray, np.ndarray]] = []
    if full:
        flat, hashes = [w for t in full for w in t], []
        for i in range(0, len(flat), WORDS):
            data = np.frombuffer(b" ".join(flat[i : i + WORDS]), np.uint8)
            stop = np.append(np.flatnonzero(data == 32), len(data))
            hashes.append(mixed(PrefixHash(data)(np.append(0, stop[:-1] + 1), stop)))
        words = np.concatenate(hashes)
        sizes = np.array([len(t) for t in full])
        out = [np.unique(x, return_counts=True) for x in np.split(words, np.cumsum(sizes)[:-1])]
    found = iter(out)
    return [next(found) if t else (np.zeros(0, U8), np.zeros(0, np.int64)) for t in texts]


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass").lower()
            ids.append(doc_id)
            texts.append(raw.split())
            size += len(raw)
            if size >= FEED:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], ids: list[int], lengths: list[int]) -> list[np.ndarray]:
    """The columns of an index of documents whose terms, counts and numbers of terms are in ``parts``, which is emptied."""
    ords = np.repeat(np.arange(len(ids), dtype=np.int32), np.concatenate([n for _, _, n in parts]))
    terms, tfs = np.concatenate([t for t, _, _ in parts]), np.concatenate([c for _, c, _ in parts])
    parts.clear()
    order = np.argsort(terms, kind="stable")
    ords, tfs, terms = ords[order], tfs[order], terms[order]
    del order
    first = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, np.int64)
    starts = np.append(first, len(terms)).astype(np.int64)
    terms = terms[first]
    key = _order(starts, ords, np.array(lengths, np.int64))
    place = np.empty(len(key), np.int32)
    place[key] = np.arange(len(key), dtype=np.int32)
    return [terms, starts, place[ords], tfs, np.array(ids, np.int64)[key], np.array(lengths, np.int64)[key]]


def write_index(docs: DataFrame, path: str, postings: int = 4_000_000) -> DataFrame:
    """Write inverted indexes of about ``postings`` postings each under ``path``; return the manifest (file, documents, words).

    An index is a file of one row: sorted term hashes, starts of their postings, ordinals and counts, ids and lengths. Its columns are large, so Python writes
    and reads them and Spark's heap never holds one. A task names its files by a fresh uuid, so a repeated task can't harm another's; only files in the manifest count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs

        fs, folder = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(folder, recursive=True)
        ids: list[int] = []
        lengths: list[int] = []
        parts: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            cells = [pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, x.nbytes], np.int32)), pa.py_buffer(x)]) for x in _merged(parts, ids, lengths)]
            row = pa.record_batch(cells, names=_names(INDEX))
            name = f"{uuid.uuid4().hex}.arrow"
            options = pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)
            with fs.open_output_stream(f"{folder}/{name}", compression=None) as out, pa.ipc.new_file(out, row.schema, options=options) as writer:
                writer.write_batch(row)
            return pa.RecordBatch.from_pydict({"file": [f"{path}/{name}"], "documents": [len(ids)], "words": [sum(lengths)]})

        for some, texts in _documents(batches):
            ids += some
            lengths += [len(t) for t in texts]
            found = _terms(texts)
            parts.append((np.concatenate([t for t, _ in found]), np.concatenate([c for _, c in found]).astype(np.int32), np.array([len(t) for t, _ in found])))
            held += len(parts[-1][0])
            del texts, found
            if held >= postings:
                yield flush()
                ids, lengths, held = [], [], 0
                release_memory()
        if ids:
            yield flush()

    return materialize(docs.mapInArrow(frugal(run), MANIFEST), "index-manifest")


def _read_index(uri: str, names: Sequence[str]) -> dict[str, pa.Buffer]:
    """Columns of the index in one file."""
    import pyarrow.fs

    fs, file = pyarrow.fs.FileSystem.from_uri(uri)
    options = pa.ipc.IpcReadOptions(use_threads=False, included_fields=[_names(INDEX).index(n) for n in names])
    with fs.open_input_file(file) as f:
        row = pa.ipc.open_file(f, options=options, memory_pool=pa.system_memory_pool()).get_batch(0)
    return {n: row.column(n)[0].as_buffer() for n in names}


class Shard:
    """An inverted index with the weights of its postings: those of BM25 but for the idf.

    Frequent terms (in more than max(64, documents / 32) documents, the commonest first as far as ``CELLS`` allows) also have
    their maximum in each block of documents, and each block a matrix of the weights of those that it has; they keep no postings.
    """

    def __init__(self, row: dict, mean: float, k1: float, b: float):
        get = lambda name, kind: np.frombuffer(row[name], kind)
        self.terms, starts, ords, tfs, self.ids = get("terms", U8), get("starts", np.int64), get("ords", np.int32), get("tfs", np.int32), get("ids", np.int64)
        self.norm, self.scale = k1 * (1 - b + b * get("lengths", np.int64) / mean), k1 + 1
        self.docs = len(self.ids)
        size = np.diff(starts)
        frequent = np.flatnonzero(size > max(64, self.docs // 32))
        frequent = frequent[np.argsort(-size[frequent], kind="stable")[: CELLS // max(1, self.docs)]]
        self.column = np.full(len(self.terms), -1, np.int32)
        self.column[frequent] = np.arange(len(frequent))
        self.scaled = self.column >= 0  # infrequent terms' weights are multiplied by their idf when a query first has them
        blocks = -(-self.docs // BLOCK_DOCS)
        self.block_max = np.zeros((len(frequent), blocks))
        self.counts = np.zeros((blocks * BLOCK_DOCS, len(frequent)), np.min_scalar_type(tfs.max(initial=0)))  # of frequent terms by document
        for i, t in enumerate(frequent):
            self.counts[ords[starts[t] : starts[t + 1]], i] = tfs[starts[t] : starts[t + 1]]
        self.blocks: list[tuple[np.ndarray, np.ndarray]] = []  # columns; weights in single precision by document and column
        for i in range(blocks):
            own = slice(i * BLOCK_DOCS, min((i + 1) * BLOCK_DOCS, self.docs))
            columns = np.flatnonzero(self.counts[own].any(0))
            weights = np.zeros((BLOCK_DOCS, len(columns)))
            there = weights[: own.stop - own.start]
            there[:] = self.counts[own].take(columns, 1)
            np.divide(there, there + self.norm[own, None], out=there, where=there > 0)
            there *= self.scale
            self.block_max[columns, i] = weights.max(0)
            self.blocks.append((columns, weights.astype(np.float32)))
        # The postings of the other terms are kept as they are.
        kept = np.repeat(~self.scaled, size)
        self.ords, tfs = ords[kept], tfs[kept]
        below = self.norm[self.ords]
        below += tfs
        self.weights = np.divide(tfs, below, out=below)
        self.weights *= self.scale
        self.size = np.where(self.scaled, 0, size)
        self.starts = np.append(0, np.cumsum(self.size))
        self.blocks_read = self.blocks_skipped = 0  # by a query each

    def top(self, terms: np.ndarray, idf: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of documents that may be among the ``k`` best of one query: all that reach ``least`` and the k-th best score here."""
        _, ids, scores = self.search(np.array([0, len(terms)]), np.arange(len(terms)), terms, idf, k, np.array([least]))
        return ids, scores

    def search(self, starts: np.ndarray, places: np.ndarray, terms: np.ndarray, idf: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of documents that may be among the ``k`` best of a batch's queries: all that reach the query's ``least`` and its k-th best score here.

        Query i has the terms at ``places[starts[i]:starts[i + 1]]`` of ``terms``, which are distinct and ascending. A term's idf must be the same in all calls.
        """
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        at[self.terms[at] != terms if len(self.terms) else slice(None)] = -1
        new = np.flatnonzero(at >= 0)
        new = new[~self.scaled[at[new]]]
        self.scaled[at[new]] = True
        self.weights[ragged(self.starts[at[new]], self.size[at[new]])] *= np.repeat(idf[new], self.size[at[new]])
        step = max(1, SUMS // max(1, len(self.blocks) * BLOCK_DOCS, len(self.block_max)))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for i in range(0, len(starts) - 1, step) if self.docs else ():
            some = starts[i : i + step + 1]
            own = places[some[0] : some[-1]]
            query, scores = np.repeat(np.arange(len(some) - 1), np.diff(some)), idf[own]
            hit = at[own] >= 0
            for rows, ids, exact in self._search(len(some) - 1, query[hit], at[own][hit], scores[hit], k, least[i : i + step].astype(float)):
                found.append((rows + i, ids, exact))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _search(self, n: int, query: np.ndarray, term: np.ndarray, idf: np.ndarray, k: int, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Postings of infrequent terms are added up. Frequent terms only bound each block, by the sum of their block maxima. Each query's block with the best
        bound sets its threshold; then blocks whose bound reaches it are scored for the queries that need them, by a product of matrices in single precision,
        and those documents again in double precision that reach the threshold within the error of that.
        """
        column = self.column[term]
        often = column >= 0
        asked = np.zeros((n, len(self.block_max)))
        asked[query[often], column[often]] = idf[often]
        single = asked.astype(np.float32)
        rare = term[~often]
        start, size = self.starts[rare], self.size[rare]
        cut, ends = np.searchsorted(query[~often], np.arange(n + 1)), np.append(0, np.cumsum(size))
        start = start - ends[:-1]
        sums = np.empty((n, len(self.blocks) * BLOCK_DOCS))
        for i in range(n):
            own = slice(cut[i], cut[i + 1])
            index = np.repeat(start[own], size[own])
            index += np.arange(ends[cut[i]], ends[cut[i + 1]])
            sums[i] = np.bincount(self.ords.take(index), self.weights.take(index), sums.shape[1])
        bound = sums.reshape(n, -1, BLOCK_DOCS).max(2)
        bound += asked @ self.block_max
        # A sum of m numbers that aren't negative is off by less than m times the precision.
        near = 1 - (len(self.block_max) + 16) * 2.0**-23
        best = np.zeros((n, k))

        def score(rows: np.ndarray, b: int) -> np.ndarray:
            columns, weights = self.blocks[b]
            scores = single[rows].take(columns, 1) @ weights.T
            scores += sums[rows, b * BLOCK_DOCS : (b + 1) * BLOCK_DOCS]
            return scores

        fresh = np.flatnonzero(least <= 0)
        first = bound[fresh].argmax(1)
        for b in np.unique(first) if k <= BLOCK_DOCS else ():
            rows = fresh[first == b]
            least[rows] = np.partition(score(rows, b), -k, 1)[:, -k] * near
        hits = []
        for b in range(len(self.blocks)):
            rows = np.flatnonzero((bound[:, b] >= least - SLACK) & (bound[:, b] > 0))
            self.blocks_read, self.blocks_skipped = self.blocks_read + len(rows), self.blocks_skipped + n - len(rows)
            if not len(rows):
                continue
            scores = score(rows, b)
            new = np.flatnonzero(scores.max(1) >= (least[rows] - SLACK) * near)
            rows, scores = rows[new], scores[new]
            row, doc = np.nonzero((scores >= ((least[rows] - SLACK) * near)[:, None]) & (scores > 0))
            hits.append((b, rows[row], doc, scores[row, doc]))
            best[rows] = np.partition(np.concatenate([best[rows], scores], 1), -k, 1)[:, -k:]
            least[rows] = np.maximum(least[rows], best[rows].min(1) * near)
        for b, rows, doc, scores in hits:
            keep = scores >= (least[rows] - SLACK) * near
            rows, doc = rows[keep], doc[keep]
            columns = self.blocks[b][0]
            for i in range(0, len(rows), 1000):
                r, d = rows[i : i + 1000], doc[i : i + 1000]
                at = b * BLOCK_DOCS + d
                weights = self.counts[at].take(columns, 1).astype(float)
                weights /= weights + self.norm[at, None]
                exact = np.einsum("ij,ij->i", asked[r].take(columns, 1), weights) * self.scale + sums[r, at]
                keep = (exact >= least[r] - SLACK) & (exact > 0)
                yield r[keep], self.ids[at[keep]], exact[keep]


def _shards(files: Sequence[str], mean: float, k1: float, b: float) -> Iterator[Shard]:
    """The indexes, one after another."""
    for file in files:
        yield Shard(_read_index(file, _names(INDEX)), mean, k1, b)
        release_memory()


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    return _best_of_each(np.zeros(len(ids), np.int64), ids, scores, k)[1:]


def _best_of_each(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each query, best first, by ascending query."""
    order = np.lexsort((ids, -np.floor(scores * 1e6 + 0.5), query))
    query = query[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[keep], ids[order[keep]], scores[order[keep]]


def _least(best: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, k: int) -> np.ndarray:
    """The ``k``-th best score of each of ``n`` queries, 0 for those with fewer."""
    full = np.flatnonzero(np.bincount(best[0], minlength=n) == k)
    least = np.zeros(n)
    least[full] = best[2][np.searchsorted(best[0], full, "right") - 1]
    return least


def search_similar(docs: DataFrame, k: int = 10, every: int = 50, k1: float = 1.2, b: float = 0.75, task_bytes: int = 64 << 20, block_queries: int = 100_000) -> DataFrame:
    """The ``k`` documents with the largest BM25 scores for every document whose id is divisible by ``every``, itself included.

    Terms are words (runs of bytes other than space and 0x09-0x0D) with A-Z lower-cased, told apart by 64-bit hashes; a query
    is the set of its document's terms. A term's idf is ln(1 + (N - df + 0.5) / (df + 0.5)); N, df and the mean length are
    those of all documents. Each task reads the indexes of about ``task_bytes`` of text from the shared folder, one after another, for about ``block_queries``
    queries at a time, which it streams from there in batches, and returns its best ``k``; the best of these are exactly the best of all.

    Null ids take no part; null texts and texts without words match nothing; rows with the same id are documents of their own.
    Returns query_id, rank (from 1), doc_id, score (rounded to six places); ties go to the smaller doc_id. Fewer rows if fewer documents share a term.
    """
    spark = docs.sparkSession
    docs = docs.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index = write_index(docs, work_path(spark, "index"))
    n, words = index.agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    schema = "query_id bigint, rank int, doc_id bigint, score double"
    if not words:
        return spark.createDataFrame([], schema)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file in (f for batch in batches for f in batch.column(0).to_pylist()):
            starts, terms = (np.frombuffer(x, np.int64) for x in _read_index(file, ("starts", "terms")).values())
            for i in range(0, len(terms), 100_000):
                yield pa.record_batch([pa.array(terms[i : i + 100_000]), pa.array(np.diff(starts[i : i + 100_001]))], names=["term", "df"])

    stored = [f for (f,) in index.select("file").collect()]
    listed = spark.createDataFrame([(f,) for f in stored], "file string")
    counted = materialize(listed.repartition(len(stored)).mapInArrow(frugal(frequencies), "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")), "df")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _documents(batches):
            found = [t for t, _ in _terms(texts)]
            yield pa.record_batch([pa.array(np.repeat(ids, [len(t) for t in found]).astype(np.int64)), pa.array(np.concatenate(found).astype(np.int64))], names=["query_id", "term"])

    asked = docs.filter(F.pmod("doc_id", F.lit(every)) == 0).mapInArrow(frugal(ask), "query_id bigint, term bigint").distinct()
    known = asked.join(counted, "term").withColumn("idf", F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    path = work_path(spark, "asked")
    grouped = known.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("x")).select("query_id", F.col("x.term").alias("terms"), F.col("x.idf").alias("idf"))
    mean = words / n

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of ``QUERIES`` queries, which are searched in one index, so that no task begins without a threshold."""
        shard = None
        for whole in batches:
            for i in range(0, whole.num_rows, QUERIES):
                batch = whole.slice(i, QUERIES)
                terms, first, places = np.unique(batch["terms"].flatten().to_numpy().astype(U8), return_index=True, return_inverse=True)
                starts = np.append(0, np.cumsum(np.diff(batch["terms"].offsets.to_numpy()))).astype(np.int64)
                asked = starts, places.astype(np.int32), terms, batch["idf"].flatten().to_numpy()[first]
                shard = shard or next(_shards(stored, mean, k1, b))
                least = _least(_best_of_each(*shard.search(*asked, k, np.zeros(batch.num_rows)), k), batch.num_rows, k)
                yield pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in (batch["query_id"].to_numpy(), *asked, least)], names=_names(BATCH))

    grouped.mapInArrow(frugal(pack), BATCH).write.parquet(path)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset
        import pyarrow.fs
        import pyarrow.parquet

        files = [f for batch in batches for f in batch.column(0).to_pylist()]
        fs, folder = pyarrow.fs.FileSystem.from_uri(path)
        blocks: list[list] = [[]]
        held = 0
        for fragment in pyarrow.dataset.dataset(folder, filesystem=fs, format="parquet").get_fragments() if files else ():
            blocks[-1].append(fragment)
            if (held := held + fragment.count_rows() * QUERIES) >= block_queries:
                blocks.append([])
                held = 0
        for block in filter(None, blocks):
            best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # of each batch: queries by their place, ids, scores
            names: list[np.ndarray] = []
            for shard in _shards(files, mean, k1, b):
                for j, row in enumerate(r for fragment in block for x in fragment.to_batches(batch_size=4, use_threads=False) for r in x.to_pylist()):
                    queries, *batch, least = (np.frombuffer(row[c], kind) for c, kind in zip(_names(BATCH), (np.int64, np.int64, np.int32, U8, np.float64, np.float64), strict=True))
                    if j == len(best):
                        best.append((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)))
                        names.append(queries)
                    found = shard.search(*batch, k, np.maximum(least, _least(best[j], len(queries), k)))
                    best[j] = _best_of_each(*(np.concatenate(x) for x in zip(best[j], found, strict=True)), k)
                del shard  # before the next is made
            for own, (query, ids, scores) in zip(names, best, strict=True):
                yield pa.record_batch([pa.array(own[query]), pa.array(ids), pa.array(scores)], names=["query_id", "doc_id", "score"])

    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()[0]
    files = listed.repartition(max(1, -(-size // task_bytes)))
    hits = files.mapInArrow(frugal(search), "query_id bigint, doc_id bigint, score double")
    hits = hits.withColumn("score", F.floor(F.col("score") * 1e6 + 0.5) / 1e6)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
