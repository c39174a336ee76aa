"""Named stores of derived tables, staging files, built-in connectors, and the hooks by which a user adds sources and exports."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: (spark, settings) -> rows
Reader = Callable[[SparkSession, dict], DataFrame]


class Transform(Protocol):
    """An export: records in, (path, body) out."""

    def __call__(self, records: DataFrame) -> DataFrame: ...


@dataclass
class IndexStore:
    """Derived tables by name under one folder: vectors, sparse weights, clusters, communities, synonyms, past contradictions.

    A table that isn't there reads as empty. ``seconds`` is how long a table that was read is taken as current; a write makes it be read again.
    """

    spark: SparkSession
    root: str
    seconds: float = 60.0
    clock: Callable[[], float] = time.monotonic
    _read: dict[str, tuple[float, DataFrame]] = field(default_factory=dict)

    def load(self, name: str, schema: str | StructType) -> DataFrame:
        at, df = self._read.get(name, (None, None))
        if at is not None and self.clock() - at < self.seconds:
            return df
        path = f"{self.root}/{name}"
        self.spark.catalog.refreshByPath(path)
        try:
            df = self.spark.read.schema(schema).parquet(path)
            df.schema  # noqa: B018  a missing folder shows here
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            df = self.spark.createDataFrame([], schema)
        self._read[name] = self.clock(), df
        return df

    def save(self, name: str, df: DataFrame) -> None:
        """Replace a table. ``df`` must not read the table itself: write what is derived from it under another name."""
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        self._read.pop(name, None)


def read_staging(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Rows of staged JSON files, each of which must be an array; reading another raises. A file of no bytes has no rows: Spark leaves it out."""
    d = spark.read.text(path, wholetext=True)
    rows = F.from_json("value", f"array<struct<{_fields(schema)}>>")
    array = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("ARRAY"), F.lit(False))
    checked = F.when(array, rows).otherwise(F.raise_error(F.concat(F.lit("not an array of records: "), F.input_file_name())).cast(f"array<struct<{_fields(schema)}>>"))
    return d.select(F.explode(checked).alias("r")).select("r.*")


def _fields(schema: str | StructType) -> str:
    s = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in s.fields)


def _csv(spark: SparkSession, settings: dict) -> DataFrame:
    return spark.read.schema(settings["schema"]).option("header", True).csv(settings["path"])


def _jsonl(spark: SparkSession, settings: dict) -> DataFrame:
    return spark.read.schema(settings["schema"]).json(settings["path"])


def _parquet(spark: SparkSession, settings: dict) -> DataFrame:
    return spark.read.parquet(settings["path"])


def _jdbc(spark: SparkSession, settings: dict) -> DataFrame:
    """Split by ``partition_column`` between ``lower`` and ``upper`` if given; else one task reads all."""
    r = spark.read.format("jdbc").option("url", settings["url"]).option("dbtable", settings["table"])
    if "partition_column" in settings:
        r = r.options(partitionColumn=settings["partition_column"], lowerBound=settings["lower"], upperBound=settings["upper"], numPartitions=settings.get("partitions", 64))
    return r.load()


CONNECTORS: dict[str, Reader] = {"csv": _csv, "jsonl": _jsonl, "parquet": _parquet, "jdbc": _jdbc}


def connector(name: str) -> Callable[[Reader], Reader]:
    """Register a reader of a new type of source."""

    def add(f: Reader) -> Reader:
        CONNECTORS[name] = f
        return f

    return add


def read_source(spark: SparkSession, settings: dict) -> DataFrame:
    """Rows of a source described by ``settings`` (``type`` and what its connector needs); an unknown type raises."""
    kind = settings.get("type")
    if kind not in CONNECTORS:
        raise ValueError(f"unknown type of source: {kind}; known are {', '.join(sorted(CONNECTORS))}")
    return CONNECTORS[kind](spark, settings)


def refuse_index(spark: SparkSession, settings: dict) -> DataFrame:
    """A source that only answers live can't be indexed."""
    raise ValueError(f"source {settings.get('id')} is live only and can't be indexed")


def export(records: DataFrame, transform: Transform, path: str) -> None:
    """Write what ``transform`` makes of ``records``, which must have path and body, as one table."""
    out = transform(records)
    if missing := {"path", "body"} - set(out.columns):
        raise ValueError(f"a transform must give {', '.join(sorted(missing))}")
    out.select("path", "body").write.mode("overwrite").parquet(path)
