"""Keyed state on Structured Streaming: phases with hysteresis, and the drift of sessions from their first vector.

Both give the rows of their batch forms (``hooks.held_phase``, ``sessions.drift``) for rows that come in order. A trigger's rows of one key are ordered before
they are handled. A row whose time is before that of the last one handled of its key comes too late: it gives a row marked ``late``, without an
answer, and changes no state. Rows with a null time, or behind the watermark, are dropped. A key's state ends once the watermark has passed its last row by ``idle_ms``; a later row starts it anew.
State lives in RocksDB, which the session must name as its state store, and survives restarts by the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Ordered(StatefulProcessor):
    """Hands a key's rows over in the order of ``ts``, and ends its state after idle time. The state is one value, whose first field is the last time in microseconds."""

    state_schema = "at long"
    columns: tuple[str, ...] = ()

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", self.state_schema)

    def step(self, state: tuple | None, row: dict, at: int) -> tuple[tuple, tuple]:
        """The next state (without its time) and the row's answer."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        d = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "seq"], kind="stable")
        old = self.state.get() if self.state.exists() else None
        state, last = (tuple(old)[1:], old[0]) if old is not None else (None, None)
        out = []
        for row in d.to_dict("records"):
            at = row["ts"].value // 1000
            if last is not None and at < last:
                out.append((row["seq"], True, *[None] * len(self.columns)))
                continue
            state, answer = self.step(state, row, at)
            last = at
            out.append((row["seq"], False, *answer))
        if last is not None and (old is None or last > old[0]):
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer(last // 1000 + self.idle_ms)
        if state is not None:
            self.state.update((last, *state))
        found = pd.DataFrame(out, columns=["seq", "late", *self.columns])
        found.insert(0, "key", key[0])
        yield found

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


class Phase(Ordered):
    state_schema, columns = "at long, active boolean", ("active",)

    def __init__(self, enter: float, leave: float, idle_ms: int):
        super().__init__(idle_ms)
        self.enter, self.leave = enter, leave

    def step(self, state, row, at):
        ratio, active = row["ratio"], bool(state and state[0])
        if ratio is not None and ratio == ratio:
            active = True if ratio >= self.enter else False if ratio < self.leave else active
        return (active,), (active,)


class Drift(Ordered):
    state_schema, columns = "at long, call long, first array<double>", ("call", "distance", "drifted")

    def __init__(self, grace: int, threshold: float, idle_ms: int):
        super().__init__(idle_ms)
        self.grace, self.threshold = grace, threshold

    def step(self, state, row, at):
        v = row["v"] if row["v"] is None else [float(x) for x in row["v"]]
        call, first = (state[0] + 1, state[1]) if state else (1, v)
        distance = None
        if v is not None and first is not None and len(v) == len(first):
            distance = max(0.0, min(1.0, 1 - sum(x * y for x, y in zip(first, v, strict=True))))
        return (call, first), (call, distance, call > self.grace and distance is not None and distance > self.threshold)


def _run(events: DataFrame, key: str, time: str, seq: str, value: Column, name: str, processor: Ordered, answers: str, late: str) -> DataFrame:
    use_rocksdb(events.sparkSession)
    kind = events.schema[key].dataType.simpleString()
    d = events.select(F.col(key).alias("key"), F.col(time).cast("timestamp").alias("ts"), F.col(seq).cast("bigint").alias("seq"), value.alias(name)).filter("ts is not null and key is not null").withWatermark("ts", late)
    out = d.groupBy("key").transformWithStateInPandas(statefulProcessor=processor, outputStructType=f"key {kind}, seq long, late boolean, {answers}", outputMode="Append", timeMode="EventTime")
    return out.withColumnsRenamed({"key": key, "seq": seq})


def held_phases(events: DataFrame, key: str, time: str, seq: str, ratio: Column, enter: float = 0.30, leave: float = 0.25, idle_ms: int = 86_400_000, late: str = "1 hour") -> DataFrame:
    """(key, seq, late, active) of every row: whether its key is active from a ratio of ``enter`` or more until one below ``leave``, as ``hooks.held_phase``.

    ``seq`` numbers a key's rows and orders those of one time; a null ratio changes nothing.
    """
    return _run(events, key, time, seq, ratio.cast("double"), "ratio", Phase(enter, leave, idle_ms), "active boolean", late)


def session_drift(events: DataFrame, session: str, time: str, seq: str, vector: str, grace: int = 3, threshold: float = 0.35, idle_ms: int = 21_600_000, late: str = "1 hour") -> DataFrame:
    """(session, seq, late, call, distance, drifted) of every call: its distance from the session's first vector, as ``sessions.drift``; idle sessions begin anew."""
    return _run(events, session, time, seq, F.col(vector).cast("array<double>"), "v", Drift(grace, threshold, idle_ms), "call long, distance double, drifted boolean", late)
