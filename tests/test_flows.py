"""Feeds that land twice, spans over two streams, and sinks that fail for a while."""

import os

from pyspark.sql import functions as F

from quarrylight.streaming import expiring, flows

MINUTE = 60_000


def write(spark, path, parts, schema):
    """A file per part, read in order."""
    for n, rows in enumerate(parts):
        before = set(path.glob("*.parquet"))
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
        for new in set(path.glob("*.parquet")) - before:
            os.utime(new, (n + 1, n + 1))
    return spark.readStream.schema(spark.read.parquet(str(path)).schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_feeds_count_once(spark, tmp_path):
    rss = "<rss><item><title>T{0}</title><link>https://x.org/{0}</link></item></rss>"
    parts = [[("a", rss.format(1), "ok", 60_000), ("b", None, "error", 61_000), ("c", "", "http_error", 62_000)], [("a", rss.format(1), "ok", 70_000), ("b", None, "error", 71_000), ("a", rss.format(2), "ok", 72_000), ("d", rss.format(1), "ok", 72_000)]]
    raw = write(spark, tmp_path / "in", parts, "source string, xml string, status string, ms long")
    feeds = raw.select("source", "xml", "status", F.timestamp_millis("ms").alias("landed"))
    q = flows.items(feeds).writeStream.format("memory").queryName("fed").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.source, r.title, r.url) for r in spark.table("fed").collect()) == [("a", "T1", "https://x.org/1"), ("a", "T2", "https://x.org/2"), ("d", "T1", "https://x.org/1")]
    seen = [p["observedMetrics"]["feeds"].asDict() for p in q.recentProgress if p["numInputRows"]]
    assert seen == [{"fetched": 2, "failed": 1, "http_errors": 1}, {"fetched": 2, "failed": 0, "http_errors": 0}]


def test_spans(spark, tmp_path):
    rows = [[("k1", 1, "s", 1), ("k2", 2, "s", 2), ("k1", 3, "e", 5), ("k3", 4, "e", 1)], [("k2", 5, "e", 200), ("k1", 6, "e", 30), (None, 7, "s", 31), ("k1", 8, "s", 40)]]
    raw = write(spark, tmp_path / "in", [[(k, i, x, m * MINUTE) for k, i, x, m in part] for part in rows], "k string, id long, x string, ms long")
    stream = raw.select("k", F.timestamp_millis("ms").alias("ts"), "id", "x")
    beat = spark.sql(f"SELECT 'beat' AS k, timestamp_millis({9_000 * MINUTE}L) AS ts, CAST(NULL AS BIGINT) AS id, CAST(NULL AS STRING) AS x")
    of = lambda e, x: e.filter((F.col("x") == x) | F.col("id").isNull())
    got = expiring.replay(spark, stream, lambda e: flows.spans(of(e, "s"), of(e, "e"), "k", "60 MINUTES"), beat).filter("start_id IS NOT NULL")
    assert sorted(((r.k, r.start_id, r.end_id, r.duration_ms) for r in got.collect()), key=str) == sorted([("k1", 1, 3, 4 * MINUTE), ("k1", 1, 6, 29 * MINUTE), ("k2", 2, None, None), (None, 7, None, None), ("k1", 8, None, None)], key=str)


def test_sinks_catch_up(spark, tmp_path):
    parts = [[("x", n * 10 + i) if i % 2 else ("y", n * 10 + i) for i in range(4)] for n in range(4)]
    stream = write(spark, tmp_path / "in", parts, "name string, id long")
    got, calls = {"x": [], "y": [], "all": []}, {"x": 0}

    def sink(topic, fails=()):
        def take(rows, epoch):
            if topic in calls:
                calls[topic] += 1
                if calls[topic] in fails:
                    raise ValueError(f"{topic} is down")
            got[topic].append((epoch, sorted(r.id for r in rows.collect())))

        return take

    ledger = str(tmp_path / "ledger")
    sinks = {"x": sink("x", (2, 3, 4)), "y": sink("y"), "all": sink("all")}
    writer = flows.route(stream, sinks, ledger)
    writer.option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    assert [e for e, _ in got["y"]] == [0, 1, 2, 3] and [e for e, _ in got["all"]] == [0, 1, 2, 3] and [e for e, _ in got["x"]] == [0]
    book = flows.Ledger(spark, ledger)
    assert book.owed("x") == [1, 2, 3] and book.owed("y") == [] and book.settled("x") == book.settled("y") == 3
    assert flows.catch_up(spark, sinks, ledger) == [] and book.owed("x") == []
    assert got["x"] == [(n, [n * 10 + 1, n * 10 + 3]) for n in range(4)]
    # an epoch that comes again goes to no sink that has settled it
    flows.route(stream, sinks, ledger).option("checkpointLocation", str(tmp_path / "again")).trigger(availableNow=True).start().awaitTermination()
    assert [e for e, _ in got["all"]] == [0, 1, 2, 3] and len(got["x"]) == 4
