"""Queries over records: pages as source rows, feed rows and official sources; first matches; session memory; ranked readable pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls
from ..operators import rank, records
from . import turns
from .common import HOST, QUERY, SOURCES, STRIP, TITLE, Query, sources, table
from .texts import _READ, _WS

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f: Query) -> Query:
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return add


@query(
    "source_records",
    f"""WITH p AS (SELECT page_id, url, {TITLE} AS title, {STRIP} AS t FROM pages) SELECT page_id, title, sha256(trim(t)) AS description_sha256, trim(url) AS url, {HOST} AS domain, 'free_public_source' AS kind, 'unknown' AS freshness, CAST(greatest(page_id % 9, 1) AS INT) AS position,
CASE WHEN page_id % 2 = 0 THEN 'read,whole' ELSE 'free_public_source' END AS signals FROM p""",
)
def source_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as source rows: what they have, and defaults for what they have not."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", T.html_title(F.col("html")).alias("title"), T.html_strip(F.col("html")).alias("t"))
    signals = F.when(F.col("page_id") % 2 == 0, F.array(F.lit("read"), F.lit("whole")))
    row = records.source_row({"title": F.concat(F.lit(" "), F.col("title")), "description": F.col("t"), "url": F.concat(F.col("url"), F.lit(" ")), "kind": F.lit(" "), "signals": signals}, F.col("page_id") % 9)
    return p.select("page_id", row["title"].alias("title"), F.sha2(row["description"], 256).alias("description_sha256"), *[row[c].alias(c) for c in ("url", "domain", "kind", "freshness", "position")], F.array_join(row["signals"], ",").alias("signals"))


@query(
    "feed_records",
    f"""WITH p AS (SELECT page_id, url, {TITLE} AS title, {STRIP} AS t FROM pages)
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'item ' || page_id ELSE regexp_replace(url, '#.*$', '') END AS id, title, regexp_replace(url, '#.*$', '') AS url, sha256(trim(t)) AS summary_sha256, CASE WHEN page_id % 3 = 0 THEN '2024-01-05 10:00:00' END AS published,
CASE WHEN page_id % 3 = 0 THEN 'cached_recent' ELSE 'cached' END AS freshness, CASE WHEN page_id % 2 = 0 THEN 'Site ' || page_id ELSE {HOST} END AS label, '2024-02-01 00:00:00' AS fetched FROM p""",
)
def feed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as items of a feed, as they are cached, and as the source rows that come from the cache."""
    n = F.col("page_id")
    p = table(spark, sf_dir, "pages").select("page_id", "url", T.html_title(F.col("html")).alias("title"), T.html_strip(F.col("html")).alias("t"))
    item = {"id": F.when(n % 2 == 0, F.concat(F.lit("item  "), n)), "title": F.concat(F.lit("\n"), F.col("title")), "link": F.concat(F.col("url"), F.lit("#part")), "description": F.col("t"), "source": F.when(n % 2 == 0, F.concat(F.lit(" Site "), n)), "date": F.when(n % 3 == 0, "Fri, 05 Jan 2024 10:00:00 GMT")}
    feed = records.feed_row(item, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    p = p.select("page_id", *[c.alias(k) for k, c in feed.items()])
    row = records.cached_row({k: F.col(k) for k in feed})
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return p.select("page_id", "id", "title", "url", F.sha2("summary", 256).alias("summary_sha256"), at("published_at").alias("published"), row["freshness"].alias("freshness"), row["label"].alias("label"), at("fetched_at").alias("fetched"))


_HOLDERS = " Jordan Lee is the current mayor of Region Beta. "


@query(
    "official_records",
    f"""WITH p AS (SELECT page_id, url, {HOST} AS domain, {TITLE} AS title, trim({STRIP}) AS t FROM pages), g AS (SELECT *, t <> '' AND page_id % 4 <> 0 AS got, t <> '' AND page_id % 4 <> 0 AND page_id % 3 = 0 AS held FROM p)
SELECT page_id, CASE WHEN got AND title <> '' THEN title ELSE domain || ' Official' END AS title, CASE WHEN got THEN sha256(t) ELSE sha256('Official source for ' || domain || ' updates and primary information.') END AS description_sha256,
CASE WHEN held THEN 'official_current_holder' WHEN got THEN 'official_page' ELSE 'unverified_link' END AS level, CASE WHEN held THEN 'Jordan Lee' ELSE '' END AS holder, CASE WHEN held THEN 'mayor' ELSE '' END AS role,
'official_source,trusted_domain,' || CASE WHEN got THEN 'page_fetched' ELSE 'page_not_fetched' END || CASE WHEN page_id % 2 = 0 THEN ',from_results' ELSE '' END || CASE WHEN held THEN ',current_office_claim' ELSE '' END AS signals FROM g""",
)
def official_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as portals: some were read, and some of these name a holder of the office in their text."""
    n = F.col("page_id")
    p = table(spark, sf_dir, "pages").select("page_id", "url", urls.host(F.col("url")).alias("domain"), T.html_title(F.col("html")).alias("title"), F.trim(T.html_strip(F.col("html"))).alias("t"))
    got = (F.col("t") != "") & (n % 4 != 0)
    text = F.concat(F.when(n % 3 == 0, F.lit(_HOLDERS)).otherwise(""), "t")
    row = records.official_row(F.concat("domain", F.lit(" Official")), F.col("url"), F.when(got, F.col("title")), F.when(got, F.col("t")), text, got, "mayor", "Region Beta", F.when(n % 2 == 0, "from_results"))
    return p.select("page_id", row["title"].alias("title"), F.sha2(row["description"], 256).alias("description_sha256"), row["level"].alias("level"), row["holder"].alias("holder"), row["role"].alias("role"), F.array_join(row["signals"], ",").alias("signals"))


@query(
    "first_candidates",
    r"""WITH a AS (SELECT doc_id, regexp_extract(text, '\S+') AS title, text FROM documents WHERE trim(coalesce(text, '')) <> ''), o AS (SELECT title, arg_min(text, doc_id) AS text, min(doc_id) AS doc_id FROM a GROUP BY title),
m AS (SELECT conv_id, turn, string_split_regex(coalesce(text, ''), '\s+') AS ws FROM conversations), t AS (SELECT conv_id, turn, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM m)
SELECT conv_id, turn, w AS candidate, doc_id, sha256(text) AS text_sha256 FROM t JOIN o ON t.w = o.title WHERE w <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) = 1""",
)
def first_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each message as ordered candidates for articles: documents, titled by their first word."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract("text", r"(\S+)", 1).alias("title"), F.col("text").alias("extract"))
    m = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("k"), F.split(F.coalesce("text", F.lit("")), r"\s+").alias("ws"))
    return records.first_found(m, d, "k", "ws", order="doc_id").select("k.conv_id", "k.turn", "candidate", "doc_id", F.sha2("extract", 256).alias("text_sha256"))


@query(
    "session_memory",
    """WITH t AS (SELECT conv_id, 0 AS part, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS o, role, coalesce(text, '') AS t FROM conversations), a AS (SELECT conv_id, 1, doc_id, lang, coalesce(text, '') FROM (SELECT DISTINCT conv_id FROM conversations) JOIN documents ON conv_id = doc_id),
h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, o) AS place FROM (SELECT * FROM t UNION ALL SELECT * FROM a) WHERE contains(lower(t), 'erth') OR contains(lower(t), 'ment'))
SELECT conv_id, CAST(place AS INT) AS place, CASE WHEN part = 0 THEN 'turn_' || o || '_' || role ELSE 'attachment_' || role END AS source, CASE WHEN part = 0 AND length(t) > 300 THEN substring(t, 1, 300) || '...' WHEN part = 1 AND length(t) > 400 THEN substring(t, 1, 400) || '...' ELSE t END AS snippet FROM h WHERE place <= 4""",
)
def session_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's turns, and the document of its number as its attachment, searched for words."""
    t = table(spark, sf_dir, "conversations")
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), F.col("doc_id").alias("ord"), F.col("lang").alias("name"), "text")
    a = a.join(t.select("conv_id").distinct(), "conv_id", "left_semi")
    return records.session_memory(t, a, "erth in ment")


@query(
    "ranked_readable",
    f"""WITH {SOURCES}, allowed AS ({turns.ORACLE["robots_longest_prefix"]}), q AS (SELECT {_WS} AS ws), r AS (SELECT page_id AS ord, {_READ} AS body FROM pages),
s AS (SELECT ord, url, domain, greatest(0, 100 - ord % 100) + 8 * len(list_filter(ws, lambda t: contains(lower(title || ' ' || description || ' ' || url), t))) - CASE WHEN regexp_matches(url, '(?i)\\.(pdf|zip|rar|7z|mp4|mp3|avi|mov)(?:$|\\?)') THEN 25 ELSE 0 END + CASE WHEN starts_with(lower(url), 'https:') THEN 2 ELSE 0 END AS score FROM sources, q),
k AS (SELECT s.*, body, row_number() OVER (PARTITION BY domain ORDER BY score DESC, s.ord) AS place FROM s JOIN r USING (ord))
SELECT domain, ord, CAST(score AS INT) AS score, CAST(place AS INT) AS place, sha256(substring(body, 1, 12000)) AS text_sha256 FROM k JOIN allowed ON allowed.page_id = k.ord WHERE place <= 8 AND allowed AND length(body) >= 120""",
)
def ranked_readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best results of each host by the engine's score; of these, pages that robots may read and that hold a readable text."""
    ws = T.query_terms(F.lit(QUERY))
    d = sources(spark, sf_dir)
    score = rank.engine_score(ws, F.col("ord") % 100, F.col("title"), F.col("description"), F.col("url"))
    best = rank.top_k(d.select("ord", "domain", score.alias("score")), 8, [F.desc("score"), F.col("ord")], ["domain"], "place")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), "html")
    allowed = turns.robots_longest_prefix(spark, sf_dir).filter("allowed").select(F.col("page_id").alias("ord"))
    # only pages that are left are read, once each: a condition on what ``explode`` makes is not moved to the table
    read = best.join(allowed, "ord").join(pages, "ord").select("domain", "ord", "score", "place", F.explode(F.array(T.readable_text(F.col("html")))).alias("body"))
    return read.filter(F.length("body") >= 120).select("domain", "ord", F.col("score").cast("int").alias("score"), F.col("place").cast("int").alias("place"), F.sha2(F.substring("body", 1, 12_000), 256).alias("text_sha256"))
