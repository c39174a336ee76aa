"""Stateful counters and incremental upkeep on Structured Streaming."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import laplace


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def source_confidence(events: DataFrame, key: str, good: Column) -> DataFrame:
    """Outcome counters per key with their Laplace confidence; run in update or complete mode."""
    n, g = F.count(F.lit(1)), F.count_if(good)
    return events.groupBy(key).agg(n.alias("injections"), g.alias("clean_after"), laplace(g, n).alias("confidence"))


def tumbling_counts(events: DataFrame, time: str, *keys: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Event-time counts per window; rows later than ``late`` are dropped by the watermark."""
    w = _timed(events, time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), *keys, "n")


def gap_sessions(events: DataFrame, time: str, key: str, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Sessions that end after ``gap`` without an event."""
    s = _timed(events, time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("events"))
    return s.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def unseen(events: DataFrame, time: str, key: str, late: str = "1 hour") -> DataFrame:
    """Each key once, which is how only sessions not seen before are built."""
    return _timed(events, time, late).dropDuplicatesWithinWatermark([key])


def upkeep(stream: DataFrame, store: str, checkpoint: str, build: Callable[[DataFrame], DataFrame], key: str = "id"):
    """Start a query that builds rows for new content only and appends them to the table at ``store``.

    A batch has its own partition, ``batch``, of the store, which it replaces, so one that failed half-way and is run again leaves no row twice; rows whose
    (key, hash) is in another batch are left out. Batches are named after the checkpoint too, so a new one doesn't replace the batches of an old one.
    """

    run = f"c{zlib.crc32(checkpoint.encode()):08x}"

    def add(batch: DataFrame, number: int) -> None:
        name = f"{run}-{number}"
        fresh = batch.dropDuplicates([key, "hash"])
        try:
            done = batch.sparkSession.read.parquet(store)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        else:
            fresh = fresh.join(done.filter(F.col("batch") != name).select(key, "hash"), [key, "hash"], "left_anti")
        build(fresh).write.mode("overwrite").parquet(f"{store}/batch={name}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
