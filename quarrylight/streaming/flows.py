"""Streams of feeds, spans and routed events: deduplicated ingest with counts, pairs with an outer result, and sinks that catch up."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.feeds import parse_feeds

# --- feeds --------------------------------------------------------------------------------------------------


def landed_once(feeds: DataFrame, delay: str = "1 day", observed: str = "feeds") -> DataFrame:
    """``feeds`` (source, xml, status, landed) without feeds that landed again, with the same text, within ``delay``.

    What the dedupe keeps is bounded by the watermark. The counts of fetched and failed sources come with each micro-batch, as the observed
    metrics ``fetched``, ``failed`` and ``http_errors`` (thrown errors are failures, refused ones were fetched).
    """
    rows = feeds.withColumn("_xml", F.sha2(F.coalesce("xml", F.lit("")), 256)).withWatermark("landed", delay).dropDuplicatesWithinWatermark(["source", "_xml", "status"]).drop("_xml")
    is_error = F.col("status") == "error"
    return rows.observe(observed, F.count_if(~is_error).alias("fetched"), F.count_if(is_error).alias("failed"), F.count_if(F.col("status") == "http_error").alias("http_errors"))


def items(feeds: DataFrame, delay: str = "1 day", observed: str = "feeds") -> DataFrame:
    """source, ord, title, url, summary, published_at of the feeds that were read, each feed once."""
    return parse_feeds(landed_once(feeds, delay, observed).filter("status = 'ok'"))


# --- spans --------------------------------------------------------------------------------------------------


def spans(starts: DataFrame, ends: DataFrame, key: str, longest: str, delay: str = "10 minutes") -> DataFrame:
    """key, start_id, end_id, duration_ms of ``starts`` and ``ends`` (key, id, ts): each start with every end of its key up to ``longest`` later, or with none.

    Both sides wait only as long as a partner may still come. A start without an end comes once the watermark has passed all its possible ends. A heartbeat
    that moves the watermarks on needs a key: rows without one are left out of a join before the watermark sees them. Rows without an id on both sides are heartbeats.
    """
    a = starts.select(F.col(key).alias("_key"), F.col("id").alias("start_id"), F.col("ts").cast("timestamp").alias("started")).withWatermark("started", delay)
    b = ends.select(F.col(key).alias("_of"), F.col("id").alias("end_id"), F.col("ts").cast("timestamp").alias("ended")).withWatermark("ended", delay)
    met = a.join(b, F.expr(f"_key = _of AND ended >= started AND ended <= started + INTERVAL {longest}"), "left_outer")
    return met.select(F.col("_key").alias(key), "start_id", "end_id", (F.unix_millis("ended") - F.unix_millis("started")).alias("duration_ms"))


# --- routes -------------------------------------------------------------------------------------------------

Sink = Callable[[DataFrame, int], None]


class Ledger:
    """What each sink has taken: the last epoch that is settled for it, and the rows of epochs that failed, kept as tables until they are taken.

    A sink may see an epoch again if the driver is lost between the sink's end and the ledger's note: it is given the epoch's number to know it by.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.jvm = spark._jvm.org.apache.hadoop.fs
        self.fs = self.jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str) -> str:
        return "/".join([self.path, *parts])

    def _numbers(self, *parts: str) -> list[int]:
        p = self.jvm.Path(self._at(*parts))
        names = [x.getPath().getName() for x in self.fs.listStatus(p)] if self.fs.exists(p) else []
        return sorted(int(n) for n in names if n.isdigit())

    def settled(self, topic: str) -> int:
        return max(self._numbers(quote(topic, ""), "settled"), default=-1)

    def settle(self, topic: str, epoch: int) -> None:
        older = self._numbers(quote(topic, ""), "settled")
        self.fs.mkdirs(self.jvm.Path(self._at(quote(topic, ""), "settled", str(epoch))))
        for n in older:
            if n < epoch:
                self.fs.delete(self.jvm.Path(self._at(quote(topic, ""), "settled", str(n))), True)

    def owed(self, topic: str) -> list[int]:
        return self._numbers(quote(topic, ""), "owed")

    def owe(self, topic: str, epoch: int, rows: DataFrame) -> None:
        # written beside and moved: what is owed is whole or not there
        made, final = self._at(quote(topic, ""), "making", str(epoch)), self._at(quote(topic, ""), "owed", str(epoch))
        rows.write.mode("overwrite").parquet(made)
        self.fs.mkdirs(self.jvm.Path(self._at(quote(topic, ""), "owed")))
        self.fs.rename(self.jvm.Path(made), self.jvm.Path(final))

    def rows(self, topic: str, epoch: int) -> DataFrame:
        return self.spark.read.parquet(self._at(quote(topic, ""), "owed", str(epoch)))

    def paid(self, topic: str, epoch: int) -> None:
        self.fs.delete(self.jvm.Path(self._at(quote(topic, ""), "owed", str(epoch))), True)


def route(stream: DataFrame, sinks: dict[str, Sink], ledger: str, name: str = "name"):
    """A writer that hands each micro-batch to the sinks by event name, ``all`` getting every row.

    A sink that fails holds up no other. Its rows are kept in the ledger and offered again, oldest first, before it gets newer ones; so every sink gets all its
    rows, in order of epochs. An epoch that the engine repeats after a failure goes only to sinks that have not settled it. ``deal.errors`` has
    the failures of the last batch.
    """

    def deal(batch: DataFrame, epoch: int) -> None:
        book = Ledger(batch.sparkSession, ledger)
        batch.persist()
        errors = []
        try:
            for topic, sink in sinks.items():
                for old in book.owed(topic):
                    try:
                        sink(book.rows(topic, old), old)
                    except Exception as e:  # noqa: BLE001
                        errors.append((topic, str(e)))
                        break
                    book.paid(topic, old)
                if epoch <= book.settled(topic):
                    continue
                mine = batch if topic == "all" else batch.filter(F.col(name) == topic)
                owed = book.owed(topic)
                if not owed:
                    try:
                        sink(mine, epoch)
                    except Exception as e:  # noqa: BLE001
                        errors.append((topic, str(e)))
                        owed = [epoch]
                if owed and epoch not in book.owed(topic):
                    book.owe(topic, epoch, mine)
                book.settle(topic, epoch)
        finally:
            batch.unpersist()
        deal.errors = errors

    return stream.writeStream.foreachBatch(deal)


def catch_up(spark: SparkSession, sinks: dict[str, Sink], ledger: str) -> list[tuple[str, str]]:
    """Offers what is owed to each sink once more, oldest first; the failures."""
    book, errors = Ledger(spark, ledger), []
    for topic, sink in sinks.items():
        for old in book.owed(topic):
            try:
                sink(book.rows(topic, old), old)
            except Exception as e:  # noqa: BLE001
                errors.append((topic, str(e)))
                break
            book.paid(topic, old)
    return errors
