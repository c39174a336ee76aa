"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space that separates words: space and 0x09-0x0D. ``bytes.split()`` splits on the same set.
WORD = r"[^\x20\x09-\x0D]+"


def work_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what ``spark.checkpoint.dir`` names. Where that is unset, a local master gets a folder
    of its own; on a cluster a machine-local folder would lose data, so this raises there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def work_path(spark: SparkSession, what: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{work_dir(spark)}/corvane-{what}-{uuid.uuid4().hex}"


#: Tables written since the innermost ``scratch`` began.
_made: list[str] = []


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The copy outlives any executor, so what is read from it later never recomputes the input.
    """
    path = work_path(df.sparkSession, what)
    _made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables that ``materialize`` writes inside are removed at the end, but for those that DataFrames put into the list given read."""
    outer, keep = _made[:], []
    _made.clear()
    yield keep
    kept = {file for df in keep for file in df.inputFiles()}
    for path in _made:
        if any(f"/{path.rsplit('/', 1)[1]}/" in file for file in kept):
            outer.append(path)
        else:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _made[:] = outer


def unused_name(columns: Sequence[str], name: str) -> str:
    """``name``, with as many underscores behind it as make it none of ``columns`` (case doesn't tell names apart)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def set_aside(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, list[Column]]:
    """``df`` with its columns called like one of ``names`` renamed, and the columns that give back what ``df`` had."""
    moved, columns = {}, list(df.columns)
    for c in df.columns:
        if c.lower() in {n.lower() for n in names}:
            moved[c] = unused_name([*columns, *names], f"_{c}")
            columns.append(moved[c])
    return df.withColumnsRenamed(moved), [F.col(f"`{moved.get(c, c)}`").alias(c) for c in df.columns]


def release_memory() -> None:
    """Give memory that Python has freed back to the system (with glibc), as workers are used again by later stages."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, whose worker starts and ends without memory that is free but still held."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        release_memory()
        yield from run(batches)
        release_memory()

    return wrapped


def int_array(values: Sequence[int]) -> Column:
    """A constant array<bigint>, folded once by the optimizer; evaluating it costs nothing per row."""
    return F.array(*[F.lit(int(v)).cast("bigint") for v in values]) if values else F.expr("cast(array() as array<bigint>)")


def lower_bound_count(key: Column, bounds: Sequence[int]) -> Column:
    """How many of the ascending ``bounds`` are <= ``key``: a binary search inside one expression."""
    n = len(bounds)
    if not n:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))])
    array = int_array(bounds)
    return F.aggregate(steps, F.lit(0), lambda p, s: F.when((p + s <= n) & (F.get(array, p + s - 1) <= key), p + s).otherwise(p))


def rank_in_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: str, per_bucket: int = 4096) -> DataFrame:
    """Add ``rank`` (from 0) of each row in its group, without putting a whole group into one task.

    ``n`` names a column with the row count of the group. A group of more than ``per_bucket`` rows
    is dealt over hash buckets; ranks run bucket by bucket, so that each window sorts about
    ``per_bucket`` rows and the buckets' starts come from a count with map-side combine. Ranks are
    0 .. n-1 in every group and depend only on ``order``; rows equal in ``order`` get neighbouring ranks.
    ``df`` is read twice and should be cheap to read.
    """
    d = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.ceil(F.col(n) / per_bucket).cast("bigint")))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = (
        d.filter(F.col(n) > per_bucket)
        .groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_kb"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    same = F.col("_bucket") == F.col("_kb")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    rank = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1 + F.coalesce(F.col("_start"), F.lit(0))
    return d.join(start, same, "left").withColumn("rank", rank.cast("bigint")).drop("_bucket", "_kb", "_start", *[f"_k{i}" for i in range(len(keys))])
