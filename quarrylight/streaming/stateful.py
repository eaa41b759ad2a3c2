"""Keyed state over streams: rate limit, circuit breaker, TTL cache. The steps are those of the batch folds.

State is per key and small; events of a key are taken in time order within a micro-batch. Late rows are
taken as they come: no watermark drops them. Every function takes a streaming (or batch) DataFrame with
``key``, ``ts`` and ``id`` columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.state import breaker_step, rate_step, ttl_step


def _in_order(pdfs: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(pdfs)).sort_values(["t", "id"])


def _keyed(events: DataFrame, key: str, extra: list | None = None) -> DataFrame:
    return events.select(F.col(key).cast("string").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), F.col("id").cast("long").alias("id"), *(extra or [])).groupBy("key")


def rate_limit(events: DataFrame, key: str, limit: int, window_ms: int) -> DataFrame:
    """key, id, allowed, retry_after_s."""

    def run(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else (0, -1)
        out = []
        for t, i in _in_order(pdfs)[["t", "id"]].itertuples(index=False):
            now, ok, wait = rate_step(now, int(t), limit, window_ms)
            out.append((k[0], i, ok, wait))
        state.update(now)
        yield pd.DataFrame(out, columns=["key", "id", "allowed", "retry_after_s"]).astype({"retry_after_s": "Int64"})

    return _keyed(events, key).applyInPandasWithState(run, "key string, id long, allowed boolean, retry_after_s long", "n long, reset long", "append", GroupStateTimeout.NoTimeout)


def circuit_breaker(events: DataFrame, key: str, failures: int = 2, cooldown_ms: int = 30_000) -> DataFrame:
    """key, id, before, after; ``events`` also has an ``outcome`` column."""

    def run(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else ("CLOSED", 0, 0)
        out = []
        for t, i, o in _in_order(pdfs)[["t", "id", "outcome"]].itertuples(index=False):
            now, seen = breaker_step(now, int(t), o, failures, cooldown_ms)
            out.append((k[0], i, seen, now[0]))
        state.update(now)
        yield pd.DataFrame(out, columns=["key", "id", "before", "after"])

    return _keyed(events, key, [F.col("outcome")]).applyInPandasWithState(run, "key string, id long, before string, after string", "state string, n long, last long", "append", GroupStateTimeout.NoTimeout)


def ttl_cache(requests: DataFrame, key: str, ttl_ms: int) -> DataFrame:
    """key, id, hit."""

    def run(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        until = state.get[0] if state.exists else -1
        out = []
        for t, i in _in_order(pdfs)[["t", "id"]].itertuples(index=False):
            until, hit = ttl_step(until, int(t), ttl_ms)
            out.append((k[0], i, bool(hit)))
        state.update((until,))
        yield pd.DataFrame(out, columns=["key", "id", "hit"])

    return _keyed(requests, key).applyInPandasWithState(run, "key string, id long, hit boolean", "until long", "append", GroupStateTimeout.NoTimeout)


def ring(events: DataFrame, key: str, size: int = 150) -> DataFrame:
    """key, kept: after each micro-batch the ids of a key's newest ``size`` events, oldest first."""

    def run(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        kept = (kept + _in_order(pdfs)["id"].astype(int).tolist())[-size:]
        state.update((kept,))
        yield pd.DataFrame({"key": [k[0]], "kept": [kept]})

    return _keyed(events, key).applyInPandasWithState(run, "key string, kept array<long>", "kept array<long>", "update", GroupStateTimeout.NoTimeout)


def route(stream: DataFrame, sinks: dict, name: str = "name"):
    """A writer that hands each micro-batch to the sinks by event name, ``all`` getting every row; one failing sink stops none of the others."""

    def deal(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        errors = []
        for topic, sink in sinks.items():
            try:
                sink(batch if topic == "all" else batch.filter(F.col(name) == topic), epoch)
            except Exception as e:  # noqa: BLE001
                errors.append((topic, str(e)))
        batch.unpersist()
        deal.errors = errors

    return stream.writeStream.foreachBatch(deal)
