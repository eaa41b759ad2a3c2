r"""WARC archives: captures written as records, read back, and assembled into one nested row per capture.

``write_warc`` lays down a request, a response or revisit, and a metadata record per capture; request and
metadata name their response in WARC-Concurrent-To. Of captures with equal payloads of at least
``min_revisit`` bytes, the one with the largest id keeps the payload; the others are revisits that refer
to it. Records are whole texts that Spark's own text writer puts out (the blank lines that end a record
are its line separator), so archives land in any store Spark can write, and no local file is made.

Files are bounded: captures of at most ``LARGE`` bytes go ``PER_FILE`` to a file, larger ones 32 (equal payloads
have equal sizes, so no revisit crosses the two). ``read_warc`` unpacks an archive as a stream, one record at a time, walks
the records by their Content-Length, and never scans for separators inside payloads. ``assemble`` joins the transaction:
request, response and metadata meet over the concurrent-to identifier.

Defined cases: null payload is empty; null url is empty; rows that repeat an id are separate captures of
the same id, and each gets its records; an empty table gives an empty archive; digests of equal payloads
are SHA-1 with the length and a second hash beside it; the winner's count per (digest, salt) is merged
before the whole digest, so a payload that a third of all pages share is never gathered.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import salts

MIN_REVISIT = 1000
LARGE = 32_768
PER_FILE = 2000
GZIP_LEVEL = "BEST_SPEED"  # Hadoop's name of a level; fewer CPU seconds for somewhat larger archives
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
FIELDS = ["record_id", "type", "concurrent_to", "refers_to", "uri", "payload_digest", "date"]
HEADERS = ["WARC-Record-ID", "WARC-Type", "WARC-Concurrent-To", "WARC-Refers-To", "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Date"]  # fixed names of the format
RAW = ", ".join(f"{f} string" for f in FIELDS) + ", http string, block binary"


def with_revisits(captures: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Adds payload_bytes, payload_digest, record_type and refers_to; ``captures`` has id, url, payload (text)."""
    n = salts(captures.sparkSession)
    rows = captures.select(
        "id", "url", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1(F.encode("payload", "UTF-8")).alias("payload_digest"), F.xxhash64("payload").alias("x")
    ).withColumn("s", F.pmod(F.xxhash64("id"), F.lit(n)))
    key = ["payload_digest", "payload_bytes", "x"]
    salted = rows.filter(F.col("payload_bytes") >= min_revisit).groupBy(*key, "s").agg(F.max("id").alias("m"), F.count(F.lit(1)).alias("k"))
    groups = salted.groupBy(*key).agg(F.max("m").alias("keeper"), F.sum("k").alias("k")).filter("k > 1").drop("k")
    back = salted.select(*key, "s").join(groups, key)
    out = rows.join(back, [*key, "s"], "left")
    revisit = F.coalesce(F.col("id") < F.col("keeper"), F.lit(False))
    return out.select(
        "id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("keeper")).alias("refers_to"),
    )


def _record(headers: list, block) -> F.Column:
    """A record without the two blank lines that end it."""
    lines = [F.lit("WARC/1.1")]
    lines += [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v)) for k, v in headers]
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.array_join(F.array_compact(F.array(*lines)), CRLF), F.lit(CRLF + CRLF), block)


def record_id(kind: str, page) -> F.Column:
    """Id and payload hash: captures that repeat an id with other payloads stay apart."""
    return F.concat(F.lit(f"<urn:x-capture:{kind}:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), F.hex(F.xxhash64("payload")), F.lit(">"))


def write_warc(captures: DataFrame, path: str, min_revisit: int = MIN_REVISIT) -> None:
    """Write ``captures`` (id, url, payload as text) as gzip archives under ``path``."""
    size = F.octet_length("payload")
    _write(captures.filter(size <= LARGE), f"{path}/small", PER_FILE, min_revisit)
    _write(captures.filter(size > LARGE), f"{path}/large", 32, min_revisit)


def _write(captures: DataFrame, path: str, per_file: int, min_revisit: int) -> None:
    c = with_revisits(captures, min_revisit)
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", "")
    main = record_id("response", F.col("id"))
    digest = F.concat(F.lit("sha1:"), F.col("payload_digest"))
    host = F.regexp_extract(url, "^[a-zA-Z]+://([^/?#]*)", 1)
    target = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[a-zA-Z]+://[^/?#]*", "")
    request = F.concat(F.lit("GET "), F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target)), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF + CRLF))
    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    response = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"), body)
    meta = F.concat(F.lit("payload-bytes: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + "capture-id: "), F.coalesce(F.col("id").cast("string"), F.lit("")))
    common = [("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", url)]
    records = [
        _record([("WARC-Type", F.col("record_type")), ("WARC-Record-ID", main), *common, ("WARC-Payload-Digest", digest), ("WARC-Refers-To", F.when(revisit, record_id("response", F.col("refers_to")))), ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))), ("Content-Type", F.lit("application/http; msgtype=response"))], response),
        _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", record_id("request", F.col("id"))), ("WARC-Concurrent-To", main), *common, ("Content-Type", F.lit("application/http; msgtype=request"))], request),
        _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", record_id("metadata", F.col("id"))), ("WARC-Concurrent-To", main), *common, ("Content-Type", F.lit("application/warc-fields"))], meta),
    ]
    out = c.select(F.explode(F.array(*records)).alias("value"))
    out.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("zlib.compress.level", GZIP_LEVEL).option("maxRecordsPerFile", len(records) * per_file).text(path)


def walk(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, one at a time."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue  # the blank lines after a record
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.partition(b":")
            headers[name.decode().lower()] = value.strip().decode("utf-8", "replace")
        yield headers, stream.read(int(headers["content-length"]))


def opened(content: bytes) -> io.BufferedIOBase:
    """The records' bytes of an archive file, unpacked as they are read."""
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The raw records: record_id, type, concurrent_to, refers_to, uri, payload_digest, date, http, block.

    For HTTP responses ``http`` is the head and ``block`` the payload; for the others ``block`` is all.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [h.lower() for h in HEADERS]
        for pdf in batches:
            for content in pdf["content"]:
                out, size = [], 0
                for headers, block in walk(opened(content)):
                    http = None
                    size += len(block)
                    if headers.get("warc-type") in ("response", "revisit"):
                        http, _, block = block.partition(b"\r\n\r\n")
                        http = http.decode("utf-8", "replace")
                    out.append((*(headers.get(h) for h in names), http, block))
                    if len(out) == 2000 or size > 8_000_000:
                        yield pd.DataFrame(out, columns=[*FIELDS, "http", "block"])
                        out, size = [], 0
                yield pd.DataFrame(out, columns=[*FIELDS, "http", "block"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInPandas(run, RAW)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: uri, response, request, metadata (structs; null where no such record is).

    Request and metadata meet their response over the concurrent-to identifier and the target. Captures
    that repeat an id with the same payload and target have equal side records, so one of each serves them
    all; the payload crosses the network once, and only in the join, whose skew adaptive execution splits.
    """
    part = F.struct("record_id", "type", "refers_to", "payload_digest", "date", "http", "block")
    is_main = F.col("type").isin("response", "revisit", "resource")
    main = records.filter(is_main).select(F.col("record_id").alias("key"), "uri", part.alias("response"))
    of = lambda kind: F.first(F.when(F.col("type") == kind, part), ignorenulls=True).alias(kind)
    sides = records.filter(~is_main).groupBy(F.col("concurrent_to").alias("key"), "uri").agg(of("request"), of("metadata"))
    return main.join(sides, ["key", "uri"], "left").select("uri", "response", "request", "metadata")


def captures_of(assembled: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to as the archives say."""
    meta = F.col("metadata.block").cast("string")
    kept = F.col("response.type") != "revisit"
    page = F.regexp_extract(meta, "capture-id: (-?[0-9]+)", 1)
    return assembled.select(
        F.when(page != "", page).cast("long").alias("page_id"),
        F.when(kept, F.octet_length("response.block")).otherwise(F.regexp_extract(meta, "payload-bytes: ([0-9]+)", 1)).cast("long").alias("payload_bytes"),
        F.when(kept, F.sha1("response.block")).otherwise(F.substring("response.payload_digest", 6, 40)).alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.when(~kept, F.regexp_extract("response.refers_to", "response:(-?[0-9]+):", 1)).cast("long").alias("refers_to"),
    )
