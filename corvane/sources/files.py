"""A sink that writes (path, body) rows as files, from the tasks, in two phases."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Attempt(WriterCommitMessage):
    """The folder of one task's attempt."""

    folder: str


def checked(path: str | None) -> str:
    """A relative path of plain segments; anything that would leave the folder raises."""
    if not path or path.startswith("/") or "\\" in path or any(p in ("", ".", "..") or p.startswith("_writing-") for p in path.split("/")):
        raise ValueError(f"not a path of a file below the folder: {path!r}")
    return path


class FileWriter(DataSourceWriter):
    """Tasks write below a folder of their attempt; the driver moves what committed attempts hold to its place and drops all else.

    So a task that fails half-way, or is run twice, leaves nothing. Rows of a task come sorted by path; a row goes on with the file
    of the row before it if both have one path, after a line feed, so a file is never held in memory.
    """

    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.job = folder.rstrip("/"), overwrite, f"_writing-{uuid.uuid4().hex}"

    def _root(self):
        import pyarrow.fs

        fs, root = pyarrow.fs.FileSystem.from_uri(self.folder)
        return fs, root.rstrip("/")

    def write(self, rows: Iterator) -> Attempt:
        fs, root = self._root()
        attempt, last, out = f"{self.job}/{uuid.uuid4().hex}", "", None
        try:
            for row in rows:
                path = checked(row[0])
                if path != last:
                    if path < last:
                        raise ValueError(f"rows must come sorted by path: {path!r} after {last!r}")
                    if out:
                        out.close()
                    fs.create_dir(f"{root}/{attempt}/{path}".rsplit("/", 1)[0], recursive=True)
                    out, last = fs.open_output_stream(f"{root}/{attempt}/{path}", compression=None), path
                else:
                    out.write(b"\n")
                out.write((row[1] or "").encode())
        finally:
            if out:
                out.close()
        return Attempt(attempt)

    def _files(self, fs, folder: str) -> list[str]:
        import pyarrow.fs

        found = fs.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True, recursive=True))
        return [f.path for f in found if f.type == pyarrow.fs.FileType.File]

    def commit(self, messages: list[Attempt | None]) -> None:
        fs, root = self._root()
        moves: dict[str, str] = {}
        for m in messages:
            if m is None:
                continue
            base = f"{root}/{m.folder}"
            for file in self._files(fs, base):
                place = f"{root}/{file.split(f'{m.folder}/', 1)[1]}"
                if place in moves:
                    self.abort(messages)
                    raise ValueError(f"two tasks wrote {place}: rows of a file must be in one partition")
                moves[place] = file
        if self.overwrite:
            for file in self._files(fs, root):
                if self.job not in file:
                    fs.delete_file(file)
        for folder in {p.rsplit("/", 1)[0] for p in moves}:
            fs.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda move: fs.move(move[1], move[0]), moves.items()))
        self.abort(messages)

    def abort(self, messages: list[Attempt | None]) -> None:
        fs, root = self._root()
        if fs.get_file_info(f"{root}/{self.job}").type.name == "Directory":
            fs.delete_dir(f"{root}/{self.job}")


class FileSink(DataSource):
    """``df.write.format("corvane_files")`` with option ``folder`` (a URI that pyarrow knows): writes (path, body) rows as files."""

    @classmethod
    def name(cls) -> str:
        return "corvane_files"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        if [f.name for f in schema.fields] != ["path", "body"]:
            raise ValueError("a file sink takes the columns path and body")
        if "folder" not in self.options:
            raise ValueError("a file sink needs the option folder")
        return FileWriter(self.options["folder"], overwrite)


def write_files(lines: DataFrame, folder: str, order: Sequence[str] = (), mode: str = "append") -> None:
    """Write ``lines`` (path, body, columns of ``order``) as the files that ``path`` names below ``folder``: of each the bodies in ``order``, a line feed between two.

    A file is written by one task, body after body; files are dealt over the tasks. ``mode`` append replaces files of the same path, overwrite removes all others too.
    A null body is an empty one; null paths, and paths that leave the folder, raise and nothing is written.
    """
    lines.sparkSession.dataSource.register(FileSink)
    d = lines.repartition("path").sortWithinPartitions("path", *order).select("path", "body")
    d.write.format("corvane_files").mode(mode).option("folder", folder).save()


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the files below ``folder``: paths relative to it, contents of 2 GB at most."""
    from pyspark.sql import functions as F

    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    base = folder.split("://", 1)[-1].rstrip("/") + "/"
    return d.select(F.substring_index(F.col("path"), base, -1).alias("path"), "content")
