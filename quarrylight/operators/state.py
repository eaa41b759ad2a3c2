"""Keyed state in batch: each key's events pass in time order through the same steps the streams use.

Events are dealt by key and sorted within their partition by key, time and id; one pass over a partition keeps the state of
the key at hand and nothing else, so memory does not follow a key's events and time follows their number. A key's events
are one sequence by nature, and so one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate_step(state: tuple[int, int], t: int, limit: int, window_ms: int) -> tuple[tuple[int, int], bool, int | None]:
    """A window opens with its first hit and ends when its time is up: new state, allowed, seconds to wait."""
    n, reset = state
    n, reset = (1, t + window_ms) if reset <= t else (n + 1, reset)
    return (n, reset), n <= limit, None if n <= limit else max(1, -(-(reset - t) // 1000))


def breaker_step(state: tuple[str, int, int], t: int, outcome: str, failures: int, cooldown_ms: int) -> tuple[tuple[str, int, int], str]:
    """New state, and the state as read at this time."""
    name, n, last = state
    seen = "HALF_OPEN" if name == "OPEN" and t - last > cooldown_ms else name
    if outcome == "ok":
        return ("CLOSED", 0, last), seen
    if outcome in ("failure", "severe"):
        n += 1
        return ("OPEN" if n >= failures or outcome == "severe" else seen, n, t), seen
    return (seen, n, last), seen


def ttl_step(until: int, t: int, ttl_ms: int) -> tuple[int, bool]:
    """A miss stores the key until its time is up; a hit does not lengthen it."""
    hit = until > t
    return (until if hit else t + ttl_ms), hit


def _sequenced(events: DataFrame, key: str, at: Column, order: Column, start: Callable, step: Callable, columns: str, extra: Column | None = None) -> DataFrame:
    """key and ``columns`` of each event; ``step(state, t, id, extra)`` gives the new state and the row."""
    kind = dict(events.select(key).dtypes)[key]
    rows = events.select(F.col(key).alias("k"), F.unix_millis(at.cast("timestamp")).alias("t"), order.cast("long").alias("id"), (extra if extra is not None else F.lit(None)).cast("string").alias("x"))
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, of = None, object()
        for pdf in batches:
            out = []
            keys = pdf["k"].tolist()
            for k, t, i, x in zip(keys, pdf["t"].tolist(), pdf["id"].tolist(), pdf["x"].tolist(), strict=True):
                if k != of and not (k is None and of is None):
                    state, of = start(), k
                state, row = step(state, t, i, x)
                out.append(row)
            made = pd.DataFrame(out, columns=names)
            made.insert(0, key, pdf["k"])
            yield made.astype({"retry_after_s": "Int64"}) if "retry_after_s" in names else made

    return rows.repartition(n, "k").sortWithinPartitions("k", "t", "id").mapInPandas(run, f"`{key}` {kind}, {columns}")


def rate_limit(events: DataFrame, key: str, at: Column, order: Column, limit: int, window_ms: int) -> DataFrame:
    """key, id, allowed, retry_after_s."""

    def step(state: tuple[int, int], t: int, i: int, _: None) -> tuple:
        state, ok, wait = rate_step(state, t, limit, window_ms)
        return state, (i, ok, wait)

    return _sequenced(events, key, at, order, lambda: (0, -1), step, "id bigint, allowed boolean, retry_after_s bigint")


def circuit_breaker(events: DataFrame, key: str, at: Column, order: Column, outcome: Column, failures: int = 2, cooldown_ms: int = 30_000) -> DataFrame:
    """key, id, before, after: the breaker's state when read at an event and when the event is recorded.

    ``outcome``: 'ok', 'failure', 'severe', anything else only reads. An open breaker read after the
    cooldown is half open; a success closes it and clears the count; one severe or ``failures`` failures open it.
    """

    def step(state: tuple[str, int, int], t: int, i: int, o: str) -> tuple:
        state, seen = breaker_step(state, t, o, failures, cooldown_ms)
        return state, (i, seen, state[0])

    return _sequenced(events, key, at, order, lambda: ("CLOSED", 0, 0), step, "id bigint, before string, after string", outcome)


def ttl_cache(requests: DataFrame, key: str, at: Column, order: Column, ttl_ms: int) -> DataFrame:
    """key, id, hit."""

    def step(until: int, t: int, i: int, _: None) -> tuple:
        until, hit = ttl_step(until, t, ttl_ms)
        return until, (i, hit)

    return _sequenced(requests, key, at, order, lambda: -1, step, "id bigint, hit boolean")


def lru_cache(requests: DataFrame, cache: str, key: str, at: Column, order: Column, size: int = 500, ttl_ms: int = 900_000) -> DataFrame:
    """cache, id, hit: least-recently-used with an age limit; one cache is one sequence of requests.

    A hit renews the place, not the age. A set at capacity evicts the oldest place even for a known key,
    and setting a known key keeps its place. At most ``size`` keys are held.
    """

    def step(held: dict[str, int], t: int, i: int, k: str) -> tuple:
        born = held.get(k)
        if born is not None and t - born > ttl_ms:
            del held[k]
            born = None
        if born is not None:
            held[k] = held.pop(k)
        else:
            if len(held) >= size:
                held.pop(next(iter(held)))
            held[k] = t
        return held, (i, born is not None)

    return _sequenced(requests.withColumn(cache, F.col(cache).cast("string")), cache, at, order, dict, step, "id bigint, hit boolean", F.col(key))


def spans(events: DataFrame, key: str, start: Column, end: Column, at: Column) -> DataFrame:
    """key, started, ended, duration_ms: starts paired with the end of the same key."""
    a = events.filter(start).select(key, at.alias("started"))
    b = events.filter(end).select(key, at.alias("ended"))
    return a.join(b, key).select(key, "started", "ended", (F.unix_millis(F.col("ended").cast("timestamp")) - F.unix_millis(F.col("started").cast("timestamp"))).alias("duration_ms"))


def rotate_keys(keys: DataFrame, start: int, order: str = "ord", state: str = "state") -> DataFrame:
    """Keys from ``start`` round, those whose breaker is not open; all if none is."""
    n = keys.count()
    out = keys.withColumn("place", F.pmod(F.col(order) - start, F.lit(max(1, n))))
    healthy = out.filter(F.col(state) != "OPEN")
    return (healthy if healthy.limit(1).count() else out).orderBy("place")
