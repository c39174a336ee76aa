"""WARC archives: writing, reading, and a capture index merged from locally sorted runs."""

from __future__ import annotations

import base64
import hashlib
import itertools
import uuid
import zlib
from collections.abc import Iterator, Sequence
from datetime import UTC, datetime, timedelta
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, materialize, work_path

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
CAPTURE = "page_id bigint, url string, urlkey string, captured_at string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, file string, position bigint"


def url_key(url: str | None) -> str:
    """The sort key of a URL: host labels reversed, then path and query, in lower case: ``com,example)/a?b``."""
    try:
        parts = urlsplit(url or "")
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return (url or "").lower()
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + tail.lower()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'page {page_id}'.encode(), usedforsecurity=False).digest())}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response, or a revisit (with HTTP headers only) of the page ``refers_to``."""
    digest = base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}"]
    head.append(f"WARC-Date: {(EPOCH + timedelta(seconds=(page_id or 0) % 10**9)).strftime('%Y-%m-%dT%H:%M:%SZ')}")
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='%/:?#[]@!$&()*+,;=~-._' + chr(39))}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to)}", f"Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def members(stream, chunk: int = 1 << 18) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member of a binary stream, holding one member at a time."""
    at, data = 0, stream.read(chunk)
    while data:
        start, got, unzip = at, [], zlib.decompressobj(31)
        while not unzip.eof:
            if not data and not (data := stream.read(chunk)):
                raise EOFError(f"the archive ends inside the record at byte {start}")
            got.append(unzip.decompress(data))
            at, data = at + len(data) - len(unzip.unused_data), unzip.unused_data
        yield start, b"".join(got)
        data = data or stream.read(chunk)


def parse_fields(head: bytes) -> dict[str, str]:
    """Header fields after the first line, names in lower case. Values may be empty or go on in lines that begin with white space; lines without a colon are passed over."""
    lines: list[str] = []
    for line in head.decode("utf-8", "replace").splitlines()[1:]:
        if line[:1] in " \t" and lines:
            lines[-1] += " " + line.strip()
        else:
            lines.append(line)
    return {k.strip().lower(): v.strip() for k, colon, v in (x.partition(":") for x in lines) if colon}


def split_head(raw: bytes) -> tuple[bytes, bytes]:
    """What stands before the first empty line, and after it; lines may end in CR LF or LF."""
    ends = [(i, n) for n in (4, 2) if (i := raw.find(b"\r\n\r\n" if n == 4 else b"\n\n")) >= 0]
    at, n = min(ends, default=(len(raw), 0))
    return raw[:at], raw[at + n :]


def parse_record(raw: bytes) -> dict:
    """Header fields in lower case, ``http`` header fields, and ``payload``: the HTTP body, or the whole block of records that aren't HTTP messages."""
    head, rest = split_head(raw)
    fields: dict = parse_fields(head)
    block = rest[: int(fields.get("content-length") or len(rest))]
    fields["http"], fields["payload"] = {}, block
    if fields.get("content-type", "").lower().startswith("application/http") or block.startswith(b"HTTP/"):
        http, fields["payload"] = split_head(block)
        fields["http"] = parse_fields(http)
    return fields


def capture(fields: dict, file: str, position: int) -> tuple:
    """The row of the capture index; digest and length are those of the payload as read, a revisit's those it names (null if it names none)."""
    kind, number = fields.get("warc-type", ""), lambda x: int(x) if x and x.strip().lstrip("-").isdigit() else None
    named = fields.get("warc-payload-digest", "")
    if kind == "revisit":
        size, digest = number(fields["http"].get("content-length")), named.rpartition(":")[2] or None
    else:
        size, digest = len(fields["payload"]), base64.b32encode(hashlib.sha1(fields["payload"], usedforsecurity=False).digest()).decode()
        # other tools may write other digests, in hexadecimal, or of a body before its transfer encoding was undone
        if "page-id" in fields and named.startswith("sha1:") and digest != named.removeprefix("sha1:"):
            raise ValueError(f"{file}: payload of the record at byte {position} doesn't match its digest")
    url = fields.get("warc-target-uri")
    url = url[1:-1] if url and url[0] == "<" and url[-1] == ">" else url
    return (number(fields.get("page-id")), url, url_key(url), fields.get("warc-date"), size, digest, kind, number(fields.get("refers-to-page-id")), file, position)


class LoserTree:
    """K-way merge of sorted sequences: each output costs one comparison per level.

    Leaves are the sequences' heads; an inner node keeps the loser of its match, the overall winner stands above the root.
    """

    def __init__(self, runs: Sequence[Sequence], key):
        self.runs, self.key, self.at = runs, key, [0] * len(runs)
        k = max(1, len(runs))
        self.heads = [self._head(i) for i in range(len(runs))] + [None] * (k - len(runs))
        self.tree = [-1] * k
        for i in range(len(runs)):
            self._play(i)

    def _head(self, i: int):
        return self.key(self.runs[i][self.at[i]]) if self.at[i] < len(self.runs[i]) else None

    def _beats(self, i: int, j: int) -> bool:
        a, b = self.heads[i], self.heads[j]
        return b is None or (a is not None and (a, i) < (b, j))

    def _play(self, i: int) -> None:
        node, k = (i + len(self.tree)) // 2, len(self.tree)
        while node > 0:
            if self.tree[node] == -1:  # while building, the first to come waits here
                self.tree[node] = i
                return
            if self._beats(self.tree[node], i):
                self.tree[node], i = i, self.tree[node]
            node //= 2
        self.tree[0] = i if k else -1

    def __iter__(self) -> Iterator:
        while self.runs and self.heads[i := self.tree[0]] is not None:
            yield self.runs[i][self.at[i]]
            self.at[i] += 1
            self.heads[i] = self._head(i)
            self._play(i)


#: At most so many payloads can be that frequent.
HOT_DIGESTS = 10_000


def write_warc(pages: DataFrame, path: str, least: int = 0, file_bytes: int = 64 << 20) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as gzipped WARC files under ``path``; return the manifest (file, records, bytes).

    Of pages with equal payloads of at least ``least`` bytes the smallest page_id becomes the response and the
    others revisits of it (null ids stand after all others; rows that repeat the smallest id are
    responses too). Payloads that make up more than one in HOT_DIGESTS of all that repeat are joined by broadcast, so that no task gets all copies of one. A task names its files by a fresh uuid, so a repeated task can't harm another's; only files in the manifest count.
    """
    text = F.coalesce(F.col("html").cast("string"), F.lit(""))
    d = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), text.alias("html"))
    d = d.withColumn("_digest", F.when(F.octet_length("html") >= least, F.sha2("html", 256)))
    first = d.filter("_digest is not null").groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    first = materialize(first.filter("_n > 1"), "warc-first")
    least_hot = (first.agg(F.sum("_n")).first()[0] or 0) / HOT_DIGESTS
    hot = first.filter(F.col("_n") > least_hot).select("_digest", F.col("_first").alias("_hot"), F.lit(True).alias("_is_hot"))
    d = d.join(F.broadcast(hot), "_digest", "left")
    alone = F.concat(F.lit("-"), F.monotonically_increasing_id())  # matches nothing, and lies anywhere
    d = d.withColumn("_digest", F.coalesce(F.when(F.col("_is_hot").isNull(), F.col("_digest")), alone))
    d = d.join(first.filter(F.col("_n") <= least_hot).drop("_n"), "_digest", "left").withColumn("_first", F.coalesce("_hot", "_first"))
    d = d.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs

        fs, folder = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(folder, recursive=True)
        out = name = None
        size = records = 0

        def close():
            out.close()
            return pa.RecordBatch.from_pydict({"file": [name], "records": [records], "bytes": [size]})

        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(4)), strict=True):
                page_id, url, html, refers_to = (x.as_py() for x in row)
                if out is None:
                    name, size, records = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                zipper = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = zipper.compress(make_record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to)) + zipper.flush()
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= file_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return materialize(d.mapInArrow(frugal(run), "file string, records bigint, bytes bigint"), "warc-manifest")


def _sorted_run(rows: list[tuple]) -> pa.RecordBatch:
    """Captures sorted by (urlkey, captured_at, page_id) as one run."""
    rows.sort(key=_order)
    names = [x.split(" ")[0] for x in CAPTURE.split(", ")]
    cols = dict(zip(names, zip(*rows, strict=True), strict=True)) if rows else {n: [] for n in names}
    types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "position": pa.int64()}
    arrays = [pa.array(cols[n], types.get(n, pa.string())) for n in names] + [pa.array([uuid.uuid4().hex] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64())]
    return pa.record_batch(arrays, names=[*names, "run", "pos"])


def _key(urlkey: str | None, captured_at: str | None, page_id: int | None, file: str | None, position: int) -> tuple:
    return (urlkey or "", captured_at or "", page_id is None, page_id or 0, file or "", position)


def _order(row: tuple) -> tuple:
    return _key(row[2], row[3], row[0], row[8], row[9])


def read_runs(manifest: DataFrame, path: str, most: int = 100_000) -> DataFrame:
    """Read the manifest's archives; each task returns sorted runs of at most ``most`` captures, with ``run`` and ``pos``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs

        fs, folder = pyarrow.fs.FileSystem.from_uri(path)
        rows: list[tuple] = []
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{folder}/{file}", compression=None) as stream:
                    for at, raw in members(stream):
                        rows.append(capture(parse_record(raw), file, at))
                        if len(rows) >= most:
                            yield _sorted_run(rows)
                            rows = []
        yield _sorted_run(rows)

    return manifest.select("file").mapInArrow(frugal(run), CAPTURE + ", run string, pos bigint")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of gzipped archives (one member a record) that lie anywhere Spark can read: captures plus ``payload`` (revisits: empty).

    Records of all types and of other tools are returned, with ``record_type`` as in the archive: page_id is null where a record has none, and so are the
    length and digest of a revisit that doesn't name them. Spark hands over a file as a whole, so one can have 2 GB at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for at, raw in members(io.BytesIO(content.as_buffer())):
                    fields = parse_record(raw)
                    row = _sorted_run([capture(fields, file, at)])
                    yield pa.RecordBatch.from_arrays([*row.columns[:-2], pa.array([fields["payload"]], pa.binary())], names=[*row.schema.names[:-2], "payload"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(frugal(run), CAPTURE + ", payload binary")


def merge_runs(runs: DataFrame, parts: int) -> DataFrame:
    """Merge sorted runs into one globally ordered index.

    Captures go by range of (urlkey, captured_at, page_id, file, position) to ``parts`` tasks, so that even one URL with very
    many captures is split, also where their ids are null or repeat; a task holds its range and gets its slices of the runs in order, one after another, and a loser tree over their
    heads gives the order in which it returns them, some thousands at a time. Partition after
    partition, the rows are the capture histories of all URLs. ``runs`` is read twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        keys = [table.column(n).to_pylist() for n in ("urlkey", "captured_at", "page_id", "file", "position")]
        heads = [0, *(i for i, (a, b) in enumerate(itertools.pairwise(table.column("run").to_pylist()), 1) if a != b), table.num_rows]
        tree = iter(LoserTree([range(a, b) for a, b in itertools.pairwise(heads)], lambda i: _key(*(k[i] for k in keys))))
        while some := list(itertools.islice(tree, 10_000)):
            yield from table.take(pa.array(some)).select(table.column_names[:-2]).to_batches()

    ranged = runs.repartitionByRange(parts, "urlkey", "captured_at", "page_id", "file", "position").sortWithinPartitions("run", "pos")
    return ranged.mapInArrow(frugal(run), CAPTURE)


def archive_pages(pages: DataFrame, least: int = 0, rows_per_part: int = 100_000) -> DataFrame:
    """Write all pages as WARC archives in the shared folder, read them back, and return the merged capture index.

    Returns one row per page: page_id, url, urlkey, captured_at, payload_bytes, payload_digest (base32 SHA-1), record_type,
    refers_to, file, position; bytes and digest are those of the full payload (null html: empty). Null URLs have an
    empty host in their key; null ids are kept; rows that repeat an id are records of their own; empty tables give an empty index. Other columns are ignored.
    """
    path = work_path(pages.sparkSession, "warc")
    manifest = write_warc(pages, path, least)
    records, size = manifest.agg(F.coalesce(F.sum("records"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), size >> 27)
    runs = materialize(read_runs(manifest.repartition(tasks, "file"), path), "warc-runs")
    return merge_runs(runs, max(1, -(-records // rows_per_part)))
