"""Keyed state that expires: rate limit, circuit breaker and TTL cache over streams, by event time.

Rows may arrive in any order within the watermark's delay. A row waits in its key's state until the watermark has passed it; a timer then takes
all rows of the key that the watermark has passed, in order of time and id, through the steps of the batch fold. So the result does not
depend on how rows were dealt to micro-batches and equals the batch result.

A second timer stands where the folded state stops to matter: a rate limiter's window is over, a cached entry is stale, a breaker is closed
without failures. When it fires, the state is cleared, so what is held follows the keys of the last window and not every key ever seen.
Rows behind the watermark of the micro-batch before are late and are dropped by the engine; rows without a time or an id have no place and are left out.

``replay`` drives such a stream over a table: to the end of its files, and then, from the checkpoint, past a heartbeat that moves the watermark on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.state import breaker_step, rate_step, ttl_step
from ..sources.shared import new_path, settings

#: Events of one key wait in the state store, so it has to be the one on disk.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Fold:
    """``step(state, t, id, x)`` gives the new state and the row; ``ends(state)`` the time from which on ``state`` is as good as ``start``, None for never."""

    start: tuple
    state: str
    step: Callable[[tuple, int, int, str | None], tuple[tuple, tuple]]
    ends: Callable[[tuple], int | None]
    columns: str


def _packed(rows: list[tuple[int, int, str | None]]) -> tuple[list[int], list[int], list[str | None]]:
    """Rows as one row of columns."""
    return [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]


class _Expiring(StatefulProcessor):
    def __init__(self, fold: Fold) -> None:
        self.fold, self.names = fold, ["key", *[c.split()[0] for c in fold.columns.split(", ")]]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.fold.state)
        # the rows of an arrival are one entry of the list, so the store is asked once an arrival and not once a row
        self.waiting = handle.getListState("waiting", "t array<bigint>, id array<bigint>, x array<string>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        latest = None
        for pdf in rows:
            got = [(int(t), int(i), x) for t, i, x in zip(pdf["t"].tolist(), pdf["id"].tolist(), pdf["x"].tolist(), strict=True) if pd.notna(t) and pd.notna(i)]
            if got:
                self.waiting.appendValue(_packed(got))
                latest = max(r[0] for r in got) if latest is None else max(latest, *(r[0] for r in got))
        if latest is not None:
            self.handle.registerTimer(latest + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted((r for held in self.waiting.get() for r in zip(*held, strict=True)), key=lambda r: r[:2])
        now = tuple(self.state.get()) if self.state.exists() else self.fold.start
        due, later = [r for r in rows if r[0] < passed], [r for r in rows if r[0] >= passed]
        out = []
        for t, i, x in due:
            now, row = self.fold.step(now, t, i, x)
            out.append((key[0], *row))
        if due:
            self.waiting.put([_packed(later)]) if later else self.waiting.clear()
        ends = self.fold.ends(now)
        if ends is not None and ends <= passed:
            self.state.clear()
        elif due:
            self.state.update(now)
            if ends is not None:
                self.handle.registerTimer(ends)
        if out:
            made = pd.DataFrame(out, columns=self.names)
            yield made.astype({"retry_after_s": "Int64"}) if "retry_after_s" in self.names else made

    def close(self) -> None:
        pass


def _run(events: DataFrame, key: str, fold: Fold, delay: str, x: str | None = None) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    rows = events.select(F.col(key).cast("string").alias("key"), at.alias("ts"), F.unix_millis(at).alias("t"), F.col("id").cast("long").alias("id"), (F.col(x) if x else F.lit(None)).cast("string").alias("x"))
    return rows.withWatermark("ts", delay).groupBy("key").transformWithStateInPandas(_Expiring(fold), f"key string, {fold.columns}", "append", "eventTime")


def rate_limit(events: DataFrame, key: str, limit: int, window_ms: int, delay: str = "10 minutes") -> DataFrame:
    """key, id, allowed, retry_after_s of ``events`` (key, ts, id). The state of a key ends with its window."""

    def step(state: tuple, t: int, i: int, _: None) -> tuple:
        now, ok, wait = rate_step(state, t, limit, window_ms)
        return now, (i, ok, wait)

    return _run(events, key, Fold((0, -1), "n bigint, reset bigint", step, lambda s: s[1], "id bigint, allowed boolean, retry_after_s bigint"), delay)


def circuit_breaker(events: DataFrame, key: str, failures: int = 2, cooldown_ms: int = 30_000, delay: str = "10 minutes") -> DataFrame:
    """key, id, before, after of ``events`` (key, ts, id, outcome). A closed breaker without failures has no state."""

    def step(state: tuple, t: int, i: int, outcome: str) -> tuple:
        now, seen = breaker_step(state, t, outcome, failures, cooldown_ms)
        return now, (i, seen, now[0])

    return _run(events, key, Fold(("CLOSED", 0, 0), "name string, n bigint, last bigint", step, lambda s: 0 if s[:2] == ("CLOSED", 0) else None, "id bigint, before string, after string"), delay, "outcome")


def ttl_cache(requests: DataFrame, key: str, ttl_ms: int, delay: str = "10 minutes") -> DataFrame:
    """key, id, hit of ``requests`` (key, ts, id). The state of a key ends when its entry is stale."""

    def step(state: tuple, t: int, i: int, _: None) -> tuple:
        until, hit = ttl_step(state[0], t, ttl_ms)
        return (until,), (i, hit)

    return _run(requests, key, Fold((-1,), "until bigint", step, lambda s: s[0], "id bigint, hit boolean"), delay)


def replay(spark: SparkSession, stream: DataFrame, build: Callable[[DataFrame], DataFrame], ends: DataFrame, checkpoint: str | None = None) -> DataFrame:
    """What ``build`` makes of ``stream`` (key, ts, id and more) once the watermark has passed all of it.

    ``ends`` has one row with the stream's columns: a heartbeat later than all rows, without an id. The stream runs to the end of what has landed;
    the heartbeat lands; the stream goes on from its checkpoint. Rows are written once each, by the file sink's log.
    """
    beats, out, checkpoint = new_path(spark, "beats"), new_path(spark, "streamed"), checkpoint or new_path(spark, "stream-state")
    with settings(spark, spark__sql__streaming__stateStore__providerClass=PROVIDER):
        for landed in (False, True):
            if landed:
                ends.select(*stream.columns).coalesce(1).write.mode("append").parquet(beats)
            both = stream.unionByName(spark.readStream.schema(ends.select(*stream.columns).schema).parquet(beats))
            built = build(both)
            built.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(built.schema).parquet(out)
