"""RSS and Atom feeds, landed as one file each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blocks, collapse, feed_text, first_tag, group, let, strip_tags

# Time formats of feeds, tried in order, and what a time has to look like for one to be tried: a failed try is slow. Week days are cut off before.
FORMATS = {"d MMM yyyy HH:mm:ss Z": r"[+-]\d{4}$", "d MMM yyyy HH:mm:ss z": r"^\d{1,19} "}


def parse_time(x: Column) -> Column:
    """RFC 822 or ISO time; null where it is neither."""
    t = F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"^[A-Za-z]{3,9},\s*", ""))
    return let({"t": t}, lambda r: F.coalesce(F.try_to_timestamp(r["t"]), *[F.when(r["t"].rlike(shape), F.try_to_timestamp(r["t"], F.lit(f))) for f, shape in FORMATS.items()]))


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """source, xml: one row per feed file."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("source"), F.col("value").alias("xml"))


def parse_feeds(feeds: DataFrame, source: str = "source", xml: str = "xml") -> DataFrame:
    """source, ord, title, url, summary, published_at. Items where the feed has any, else entries; rows without title or URL go."""
    x = F.col(xml)
    found = feeds.select(source, xml, blocks(x, "item").alias("items"))
    rss = F.size("items") > 0
    rows = found.select(source, (~rss).alias("atom"), F.posexplode(F.when(rss, F.col("items")).otherwise(blocks(x, "entry"))).alias("ord", "b"))
    b = F.col("b")
    first = lambda *tags: F.coalesce(*[F.nullif(first_tag(b, t), F.lit("")) for t in tags], F.lit(""))
    href = feed_text(group(b, r"""(?i)<link\b[^>]*href=["']([^"']+)["'][^>]*>"""))
    url = F.when(F.col("atom"), F.coalesce(F.nullif(href, F.lit("")), feed_text(first("id")))).otherwise(feed_text(first("link")))
    # inside an array, as a filter on columns would be moved below them and make them again
    named = F.filter(F.array(F.struct(feed_text(first("title")).alias("title"), url.alias("url"))), lambda r: (r["title"] != "") & (r["url"] != ""))
    kept = rows.select(source, "ord", "atom", "b", F.inline(named))
    summary = F.when(F.col("atom"), first("summary", "content")).otherwise(first("description", "content"))
    return kept.select(
        source, "ord", "title", "url", F.substring(collapse(strip_tags(feed_text(summary))), 1, 500).alias("summary"),
        parse_time(feed_text(first("pubDate", "published", "updated"))).alias("published_at"),
    )


def ingest(feeds: DataFrame, status: str = "status") -> DataFrame:
    """fetched, failed, http_errors: outcomes of a round of fetches (thrown errors are failures, refused ones were fetched)."""
    return feeds.agg(F.count_if(F.col(status) != "error").alias("fetched"), F.count_if(F.col(status) == "error").alias("failed"), F.count_if(F.col(status) == "http_error").alias("http_errors"))
