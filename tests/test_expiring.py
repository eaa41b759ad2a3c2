"""Expiring state: streams in shuffled arrival against the batch folds, and what is left in the state store."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import state
from quarrylight.streaming import expiring

MINUTE = 60_000


@pytest.fixture(scope="module")
def arrivals(spark, tmp_path_factory):
    """400 events of six users and null over eight files; within a file and to the next one, arrival is out of order by less than the delay."""
    rng = random.Random(5)
    rows = [(rng.choice(["0", "1", "2", "3", "4", None]), t * MINUTE + rng.randint(0, 900), t, rng.choice(["ok", "failure", "severe", "read"])) for t in range(400)]
    df = spark.createDataFrame(rows, "k string, ms long, id long, outcome string").select("k", F.timestamp_millis("ms").alias("ts"), "id", "outcome")
    path = str(tmp_path_factory.mktemp("arrivals"))
    dealt = sorted(rows, key=lambda r: r[1] + rng.randint(0, 25 * MINUTE))
    for n in range(8):
        ids = [r[2] for r in dealt[n * 50 : n * 50 + 50]]
        df.filter(F.col("id").isin(ids)).orderBy(F.rand(3)).coalesce(1).write.mode("append").parquet(path)
    return df, path


CASES = {
    "limit": (lambda e: expiring.rate_limit(e, "k", 3, 30 * MINUTE, "60 minutes"), lambda e: state.rate_limit(e, "k", F.col("ts"), F.col("id"), 3, 30 * MINUTE)),
    "breaker": (lambda e: expiring.circuit_breaker(e, "k", 2, 20 * MINUTE, "60 minutes"), lambda e: state.circuit_breaker(e, "k", F.col("ts"), F.col("id"), F.col("outcome"), 2, 20 * MINUTE)),
    "cache": (lambda e: expiring.ttl_cache(e, "k", 20 * MINUTE, "60 minutes"), lambda e: state.ttl_cache(e, "k", F.col("ts"), F.col("id"), 20 * MINUTE)),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_equals_batch_and_expires(spark, arrivals, tmp_path, name):
    events, path = arrivals
    streamed, batch = CASES[name]
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    beat = events.groupBy().agg((F.max("ts") + F.expr("INTERVAL 9 DAYS")).alias("ts")).select(F.lit(None).cast("string").alias("k"), "ts", F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("outcome"))
    got = expiring.replay(spark, source, streamed, beat, str(tmp_path / "at"))
    want = batch(events)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    held = lambda var: spark.read.format("statestore").option("stateVarName", var).load(str(tmp_path / "at"))
    assert held("waiting").count() == 0
    if name == "breaker":  # what is left are breakers that failures have opened or counted
        assert all(r.value.n > 0 for r in held("state").collect())
    else:
        assert held("state").count() == 0


def test_late_rows_and_rows_without_place(spark, tmp_path):
    rows = [("a", MINUTE, 1), ("a", 500 * MINUTE, 2), (None, None, 3), ("b", 501 * MINUTE, None)]
    make = lambda rs: spark.createDataFrame(rs, "k string, ms long, id long").select("k", F.timestamp_millis("ms").alias("ts"), "id").coalesce(1)
    make(rows).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(make(rows).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    # the engine drops by the watermark of the batch before, so the late row lands one file later
    for n, more in enumerate(([("c", 502 * MINUTE, 6)], [("a", MINUTE + 1, 4)]), start=1):
        for file in (tmp_path / "in").glob("*.parquet"):
            if os.path.getmtime(file) > 10:
                os.utime(file, (n, n))  # older files are read first
        make(more).write.mode("append").parquet(str(tmp_path / "in"))
    got = expiring.replay(spark, source, lambda e: expiring.ttl_cache(e, "k", MINUTE), make([(None, 9_000 * MINUTE, None)]))
    assert {(r.id, r.hit) for r in got.collect()} == {(1, False), (2, False), (6, False)}
