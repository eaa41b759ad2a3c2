"""Queries over documents, pages and embeddings: text functions, chunks, ranking, dedupe, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, rules, urls
from ..functions import queries as Q
from ..functions import text as T
from ..operators import chunk, postings, rank, vector_index
from ..sources.shared import written
from .common import AS_OF, HOST, QUERY, SOURCES, Query, collapse, hits, like, lit, sources, sub, table, terms, words

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# --- chunks ------------------------------------------------------------------------------------------------

_CLEAN = collapse("coalesce(text, '')")


def chunk_sql(size: int = 1400, overlap: int = 160, most: int = 24) -> str:
    piece = f"substring(t, i, {size})"
    at = f"CASE WHEN length({piece}) < {size} THEN length({piece}) WHEN instr(reverse({piece}), ' ') = 0 THEN -1 ELSE {size} - instr(reverse({piece}), ' ') END"
    return f"""c0 AS (SELECT doc_id, {_CLEAN} AS t FROM documents),
walk AS (
  SELECT doc_id, t, 1 AS i, 0 AS k, 0 AS n FROM c0 WHERE t <> ''
  UNION ALL
  SELECT doc_id, t, nxt, k + 1, n FROM (
    SELECT doc_id, t, i, k, w AS n, greatest(i + w - {overlap}, i + 1) AS nxt, i + w - 1 >= length(t) AS done FROM (
      SELECT *, CASE WHEN a > {size * 0.55} THEN a + 1 ELSE length({piece}) END AS w FROM (SELECT doc_id, t, i, k, {at} AS a FROM walk)))
  WHERE NOT done AND k + 1 < {most}),
cut AS (SELECT doc_id, k AS chunk_index, trim(substring(t, i, CASE WHEN a > {size * 0.55} THEN a + 1 ELSE length({piece}) END)) AS chunk FROM (SELECT doc_id, t, i, k, {at} AS a FROM walk))"""


@query("chunk_documents", f"WITH RECURSIVE {chunk_sql()} SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index, chunk FROM cut WHERE chunk <> ''")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunk.explode_chunks(docs, "text").select("doc_id", "chunk_index", "chunk")


_KEYS = terms(lit(QUERY), "[a-z0-9]{3,}")
_AGE = "greatest(0.0, 20.0 - CAST(doc_id % 40 AS DOUBLE)) / 4"


@query(
    "ranked_chunk_search",
    f"""WITH RECURSIVE {chunk_sql()}, q AS (SELECT {_KEYS} AS ws),
s AS (SELECT doc_id, chunk_index, {_AGE} + {hits("ws", ("chunk", 2))} AS score FROM cut, q WHERE chunk <> ''),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk_index) AS r FROM s)
SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index, round(score, 6) AS score FROM b WHERE r = 1 ORDER BY score DESC, doc_id LIMIT 10""",
)
def ranked_chunk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best chunk of each document by query words and freshness, then the ten best."""
    parts = chunk_documents(spark, sf_dir)
    age = (F.col("doc_id") % 40).cast("double")
    score = rank.freshness_score(T.long_terms(F.lit(QUERY)), age, F.lit(""), F.lit(""), F.col("chunk"))
    best = parts.select("doc_id", F.struct(score.alias("score"), (-F.col("chunk_index")).alias("at")).alias("k")).groupBy("doc_id").agg(F.max("k").alias("k"))
    out = best.select("doc_id", (-F.col("k.at")).cast("int").alias("chunk_index"), F.round("k.score", 6).alias("score"))
    return out.orderBy(F.desc("score"), "doc_id").limit(10)


@query(
    "benchmark_chunk_search",
    f"""WITH RECURSIVE {chunk_sql(most=1_000_000)}, q AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}')) AS ws FROM benchmark),
s AS (SELECT query_id, doc_id, chunk_index, len(list_filter(ws, lambda t: contains(low, t))) AS score FROM (SELECT *, lower(chunk) AS low FROM cut WHERE chunk <> ''), q)
SELECT query_id, doc_id, CAST(chunk_index AS INT) AS chunk_index, CAST(score AS INT) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_index) AS INT) AS place FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_index) <= 12""",
)
def benchmark_chunk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage as a query over all chunks of all documents: its twelve best chunks by terms held."""
    parts = chunk.explode_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", most=None)
    index = postings.build(parts, F.struct("doc_id", "chunk_index"), F.col("chunk"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.long_terms(F.col("text")).alias("terms"))
    return postings.search(index, asked, 12).select("query_id", "key.doc_id", "key.chunk_index", "score", "place")


# --- tokens and words ----------------------------------------------------------------------------------------


def _sorted(x: str) -> str:
    return f"array_to_string(list_sort({x}), ' ')"


def _spaced(stop: list[str]) -> str:
    parts = f"string_split_regex({sub('lower(text)', ('[^a-z0-9' + chr(92) + 's]', ' '))}, '\\s+')"
    return f"list_distinct(list_filter({parts}, lambda t: length(t) > 1 AND NOT list_contains({words(stop)}, t))[1:16])"


@query(
    "token_sets",
    f"""SELECT doc_id, len({terms("text")}) AS n_query_terms, {_sorted(terms("text", "[a-z0-9]{3,}"))} AS long_terms,
len({terms("text", "[a-z0-9][a-z0-9.+-]+", T.STOP_FRESH)}) AS n_fresh_terms, {_sorted(_spaced(T.STOP_RELEVANCE))} AS relevance_terms, {_sorted(_spaced(T.STOP_TOPIC))} AS topic_terms,
len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}'), lambda t: NOT list_contains({words(T.STOP_INTENT)}, t))) AS n_intent_tokens,
len(list_distinct(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_.''-]*'))) AS n_identifiers FROM documents""",
)
def token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's runs of letters and digits are found once; all but two of the columns follow from them."""
    x = F.col("text")
    flat = lambda c: F.array_join(F.sort_array(c), " ")
    found = table(spark, sf_dir, "documents").select("doc_id", "text", T.runs(x).alias("runs"))
    found = found.select("doc_id", "text", F.array_distinct("runs").alias("terms"), F.filter("runs", lambda t: F.length(t) > 1).alias("words"))
    return found.select(
        "doc_id",
        F.size("terms").cast("long").alias("n_query_terms"),
        flat(F.filter("terms", lambda t: F.length(t) > 2)).alias("long_terms"),
        F.size(T.fresh_terms(x)).cast("long").alias("n_fresh_terms"),
        flat(T.first_terms(F.col("words"), T.STOP_RELEVANCE, 16)).alias("relevance_terms"),
        flat(T.first_terms(F.col("words"), T.STOP_TOPIC, 16)).alias("topic_terms"),
        F.size(F.filter("words", lambda t: ~t.isin(T.STOP_INTENT))).cast("long").alias("n_intent_tokens"),
        F.size(T.code_tokens(x)).cast("long").alias("n_identifiers"),
    )


_TOK = "string_split_regex(t, '\\s+')"
_CUT = sub(f"array_to_string({_TOK}[1:20], ' ')", (r"[,\s]+$", ""))


@query(
    "word_count_trim",
    f"""WITH d AS (SELECT doc_id, {sub("text", (chr(94) + r"\s+|\s+$", ""))} AS t FROM documents)
SELECT doc_id, len(regexp_extract_all(t, {lit(T.WORD)})) AS n_words,
CASE WHEN len({_TOK}) <= 20 THEN t WHEN {like(_CUT, "[.!?]$")} THEN {_CUT} ELSE {_CUT} || '.' END AS first_words,
CASE WHEN len(regexp_extract_all(t, {lit(T.WORD)})) <= 20 OR len({_TOK}) <= 20 THEN t WHEN {like(_CUT, "[.!?]$")} THEN {_CUT} ELSE {_CUT} || '.' END AS enforced FROM d""",
)
def word_count_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("text")
    n = F.lit(20)
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.count_words(x).cast("long").alias("n_words"), T.trim_words(x, 20).alias("first_words"), T.enforce_words(x, F.lit("max"), F.lit(0), n, n).alias("enforced")
    )


@query(
    "useful_text_filter",
    f"""SELECT doc_id, length({_CLEAN}) >= 40 AND len(regexp_extract_all({_CLEAN}, '[A-Za-zÀ-ɏ]')) >= 24 AS useful, sha256(text) AS fingerprint, substring({_CLEAN}, 1, 500) AS query FROM documents""",
)
def useful_text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.useful_text(x).alias("useful"), F.sha2(x, 256).alias("fingerprint"), T.search_query(x).alias("query"))


@query("secret_redaction", f"SELECT doc_id, substring(trim({sub(sub('text', (chr(92) + 's+', ' ')), ('[A-Za-z0-9_-]{24,}', '[redacted]'))}), 1, 220) AS redacted FROM documents")
def secret_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.redact(F.col("text")).alias("redacted"))


@query(
    "language_script_detect",
    """SELECT doc_id, CASE WHEN regexp_matches(text, '[\\x{0B80}-\\x{0BFF}]') THEN 'ta-IN' WHEN regexp_matches(text, '[\\x{0C00}-\\x{0C7F}]') THEN 'te-IN'
WHEN regexp_matches(text, '[\\x{0C80}-\\x{0CFF}]') THEN 'kn-IN' WHEN regexp_matches(text, '[\\x{0900}-\\x{097F}]') THEN 'hi-IN' END AS script,
CASE WHEN lower(lang) LIKE 'ta%' THEN 'ta-IN' WHEN lower(lang) LIKE 'te%' THEN 'te-IN' WHEN lower(lang) LIKE 'kn%' THEN 'kn-IN' WHEN lower(lang) LIKE 'hi%' THEN 'hi-IN' ELSE 'en-US' END AS locale,
CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN printf('%.1f KB', floor(n_chars / 102.4 + 0.5) / 10) ELSE printf('%.1f MB', floor(n_chars / 104857.6 + 0.5) / 10) END AS size FROM documents""",
)
def language_script_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.script_language(F.col("text")).alias("script"), T.locale(F.col("lang")).alias("locale"), T.byte_size(F.col("n_chars")).alias("size"))


@query("exact_dedupe", "SELECT min(doc_id) AS doc_id, sha256(text) AS fingerprint FROM documents GROUP BY text")
def exact_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("fingerprint"))
    return rank.keep_first(docs, F.col("fingerprint"), "doc_id")


@query(
    "near_duplicate_sections",
    r"""WITH RECURSIVE c AS (SELECT doc_id, len(string_split(text, chr(10))) AS n, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS parts FROM documents),
m AS (SELECT doc_id, n, list_transform(parts, lambda x: substring(trim(regexp_replace(x, '\s+', ' ', 'g')), 1, 1200)) AS p FROM c),
w AS (SELECT doc_id, 0 AS i, []::VARCHAR[] AS kept FROM m UNION ALL SELECT w.doc_id, i + 1, CASE WHEN len(list_filter(kept, lambda y: p[i + 1] <> '' AND y <> '' AND (y = p[i + 1] OR contains(y, substring(p[i + 1], 1, 300)) OR contains(p[i + 1], substring(y, 1, 300))))) > 0 THEN kept ELSE list_append(kept, p[i + 1]) END FROM w JOIN m USING (doc_id) WHERE i < len(p))
SELECT m.doc_id, CAST(n AS INT) AS n_sections, CAST(len(kept) AS INT) AS n_kept FROM w JOIN m USING (doc_id) WHERE i = len(p)""",
)
def near_duplicate_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections (lines) of each document, keep-first without near-duplicates: a greedy fold per document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("parts"))
    return docs.select("doc_id", F.size("parts").alias("n_sections"), F.size(rank.dedupe_sections(F.col("parts"))).alias("n_kept"))


@query("clean_texts", f"SELECT doc_id, trim({sub('text', (r'(?i)' + chr(92) + r'b(?:um+|uh+|er+|ah+|erm+)' + chr(92) + 'b', ''), (chr(92) + r's{2,}', ' '))}) AS spoken FROM documents")
def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.fillers(F.col("text")).alias("spoken"))


# --- pages -------------------------------------------------------------------------------------------------------

_ENT = [("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&quot;", '"'), ("&#39;", "'"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">")]
_BODY = "CASE WHEN regexp_extract(html, '(?is)<article\\b[^>]*>(.*?)</article>', 1) <> '' THEN regexp_extract(html, '(?is)<article\\b[^>]*>(.*?)</article>', 1) ELSE html END"
_READ = sub(
    _BODY,
    *[(rf"(?is)<{t}\b.*?</{t}>", " ") for t in (*T.NOISE_TAGS, *T.FRAME_TAGS)],
    (rf"""(?is)<[^>]+class=["'][^"']*(?:{T.NOISE_CLASSES})[^"']*["'][^>]*>.*?</[^>]+>""", " "),
    *_ENT,
    (r"(?i)<br\s*/?>", "\n"), (r"(?i)</(?:p|div|section|article|li|h1|h2|h3|h4)>", "\n"), (r"<[^>]+>", " "), (r"[ \t]+", " "), (r"\n\s+", "\n"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", ""),
)


@query("html_readable_text", f"SELECT page_id, substring({_READ}, 1, 12000) AS readable FROM pages")
def html_readable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.readable_text(F.col("html")).alias("readable"))


@query("html_title", f"WITH {SOURCES} SELECT ord AS page_id, title, '' AS meta, description FROM sources")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", T.html_title(F.col("html")).alias("title"), T.html_description(F.col("html")).alias("meta"), F.substring(F.trim(T.html_strip(F.col("html"))), 1, 200).alias("description"))


_KEY = "lower(regexp_replace(regexp_replace(CASE WHEN regexp_matches(url, '^[a-zA-Z]+://[^/?#]+([?#]|$)') THEN regexp_replace(url, '^([a-zA-Z]+://[^/?#]+).*$', '\\1/') ELSE url END, '[?#].*$', ''), '/$', ''))"


@query("url_canonical_dedupe", f"WITH k AS (SELECT page_id, {_KEY} AS key FROM pages), m AS (SELECT key, min(page_id) AS page_id FROM k GROUP BY key) SELECT page_id, key FROM m")
def url_canonical_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", urls.canonical_key(F.col("url")).alias("key"))
    return rank.keep_first(p, F.col("key"), "page_id")


@query(
    "url_parts",
    rf"""SELECT page_id, {HOST} AS host, regexp_replace(url, '#.*$', '') AS normalized,
regexp_matches({HOST}, '{urls.OFFICIAL}') AS official, true AS public, {HOST} LIKE '%.org' OR {HOST} LIKE '%.gov' OR {HOST} LIKE '%.edu' AS trusted FROM pages""",
)
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", urls.host(u).alias("host"), urls.normalize(u).alias("normalized"), urls.is_official(u).alias("official"), urls.is_public(u).alias("public"), urls.is_trusted_domain(urls.host(u)).alias("trusted")
    )


# --- ranking --------------------------------------------------------------------------------------------------------

_WS = terms(lit(QUERY))
_T1 = " + ".join(
    [
        "CASE WHEN level = 'structured_claim' THEN 45 ELSE 0 END",
        "CASE WHEN trusted THEN 12 ELSE 0 END",
        "CASE WHEN date <> '' THEN 2 ELSE 0 END",
        "CASE kind WHEN 'official_source' THEN 30 WHEN 'trusted_news' THEN 8 WHEN 'encyclopedia' THEN 4 WHEN 'structured_reference' THEN 3 WHEN 'community_discussion' THEN -6 WHEN 'reference_lookup' THEN -12 WHEN 'archive_lookup' THEN -16 ELSE 0 END",
        hits("ws", ("title", 5), ("domain", 4), ("description", 2)),
    ]
)


@query("source_rank", f"WITH {SOURCES}, q AS (SELECT {_WS} AS ws) SELECT ord, CAST({_T1} AS INT) AS score FROM sources, q ORDER BY score DESC, ord LIMIT 50")
def source_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sources(spark, sf_dir)
    score = rank.source_score(T.query_terms(F.lit(QUERY)), *[F.col(c) for c in ("title", "description", "domain", "kind", "level", "trusted", "date")])
    return d.select("ord", score.cast("int").alias("score")).orderBy(F.desc("score"), "ord").limit(50)


_HAY = "lower(title || ' ' || description || ' ' || domain)"
_RT = f"list_distinct(list_filter(string_split_regex({sub(lit(QUERY), ('[^a-z0-9' + chr(92) + 's]', ' '))}, '\\s+'), lambda t: length(t) > 1 AND NOT list_contains({words(T.STOP_RELEVANCE)}, t))[1:16])"
_Y = f"CAST(nullif(regexp_extract({_HAY}, '\\b(20\\d{{2}})\\b', 1), '') AS INT)"


@query(
    "live_source_rank",
    f"""WITH {SOURCES}, q AS (SELECT {_RT} AS ws), s AS (SELECT ord, len(list_filter(ws, lambda t: contains({_HAY}, t))) AS overlap, len(ws) AS n, kind, trusted, fetched, {_HAY} AS hay, {_Y} AS y FROM sources, q),
v AS (SELECT ord, CAST(overlap AS INT) AS overlap, CAST(CASE WHEN overlap > 0 THEN overlap * 2 WHEN n > 0 THEN -2 ELSE 0 END + CASE WHEN trusted OR kind IN ('official_source', 'trusted_news') THEN 3 ELSE 0 END
 + CASE WHEN fetched THEN 2 ELSE 0 END - CASE WHEN kind = 'official_source' AND NOT fetched THEN 1 ELSE 0 END + CASE WHEN {like("hay", chr(92) + "b(latest|today|update|updates|current|now|recent)" + chr(92) + "b")} THEN 2 ELSE 0 END
 + CASE WHEN {like("hay", chr(92) + "b(reuters|the hindu|indian express|bbc|ap news)" + chr(92) + "b")} THEN 2 ELSE 0 END + CASE WHEN y >= 2023 THEN 2 WHEN y <= 2021 THEN -3 ELSE 0 END AS INT) AS score FROM s)
SELECT ord, score, overlap FROM v WHERE overlap > 0 OR score >= 0 ORDER BY score DESC, ord LIMIT 50""",
)
def live_source_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sources(spark, sf_dir)
    k = rank.live_score(T.relevance_terms(F.lit(QUERY)), *[F.col(c) for c in ("title", "description", "domain", "kind", "trusted", "fetched")], 2024)
    out = d.select("ord", k.alias("k")).select("ord", F.col("k.score").cast("int").alias("score"), F.col("k.overlap").cast("int").alias("overlap"))
    return out.filter("overlap > 0 OR score >= 0").orderBy(F.desc("score"), "ord").limit(50)


_EW = f"list_filter(string_split({lit(QUERY)}, ' '), lambda t: length(t) > 2)"


@query(
    "engine_rank",
    f"""WITH {SOURCES}, q AS (SELECT list_distinct({_EW}) AS ws) SELECT ord, CAST(greatest(0, 100 - ord % 120) + len(list_filter(ws, lambda t: contains(lower(title || ' ' || description || ' ' || url), t))) * 8
- CASE WHEN {like("url", r"(?i)\.(pdf|zip|rar|7z|mp4|mp3|avi|mov)(?:$|\?)")} THEN 25 ELSE 0 END + CASE WHEN lower(url) LIKE 'https:%' THEN 2 ELSE 0 END AS INT) AS score FROM sources, q ORDER BY score DESC, ord LIMIT 50""",
)
def engine_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = F.array_distinct(F.filter(F.split(F.lit(QUERY), " "), lambda t: F.length(t) > 2))
    score = rank.engine_score(ws, F.col("ord") % 120, F.col("title"), F.col("description"), F.col("url"))
    return sources(spark, sf_dir).select("ord", score.cast("int").alias("score")).orderBy(F.desc("score"), "ord").limit(50)


@query("trusted_host_join", f"WITH {SOURCES}, h AS (SELECT unnest({words(urls.TRUSTED_HOSTS + ['example.com'])}) AS host) SELECT s.ord, h.host FROM sources s JOIN h ON s.domain = h.host OR suffix(s.domain, '.' || h.host)")
def trusted_host_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffix join as an equality join: each domain is exploded into its own suffixes, which carry no quadratic cost."""
    hosts = spark.createDataFrame([(h,) for h in [*urls.TRUSTED_HOSTS, "example.com"]], "host string")
    labels = F.split("domain", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return sources(spark, sf_dir).select("ord", F.explode(ends).alias("host")).join(F.broadcast(hosts), "host").select("ord", "host")


# The query is about a current topic; its subject is "thention erthe onre and thoning", its own terms that and "reviews".
_SUBJECT = ["thention", "erthe", "onre", "thoning"]
_LOW = "lower(title || ' ' || description || ' ')"
_COUNT = lambda ws: f"len(list_filter({words(ws)}, lambda t: contains({_LOW}, t)))"
_RELATED = f"(contains({sub(_LOW, ('[^a-z0-9]+', ' '))}, 'thention erthe onre and thoning') OR ({_COUNT(_SUBJECT)} >= 3 AND {_COUNT([*_SUBJECT, 'reviews'])} >= 3))"


def about(query_text: str):
    """Relatedness of the rows of ``sources`` to a query."""
    return Q.related(F.lit(query_text), F.col("title"), F.col("description"), F.lit(""), F.col("kind"), F.col("date"))


@query(
    "citation_filter",
    f"""WITH {SOURCES} SELECT ord, CASE WHEN title = '' OR kind IN ('reference_lookup', 'archive_lookup', 'community_discussion') OR length(description) < 20 THEN false
WHEN {like("lower(title || ' ' || description || ' ' || url)", rules.SEARCH_PAGE)} OR {like("domain", rules.ARCHIVE)} THEN false WHEN kind = 'official_source' AND NOT fetched THEN false
WHEN level = 'structured_claim' THEN true WHEN kind LIKE 'free_%' THEN true ELSE {_RELATED} END AS citable,
coalesce(level = 'structured_claim' OR (kind = 'official_source' AND fetched) OR (trusted AND NOT {like("domain", r"(?i)reddit|archive\.(today|ph|is)")}) OR {like("domain", rules.STRONG_DOMAIN)}, false) AS strong FROM sources""",
)
def citation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = {n: F.col(n) for n in ("title", "url", "description", "kind", "domain", "fetched", "level", "trusted")}
    ok = rules.is_citation(F.lit(QUERY), c["title"], c["url"], c["description"], c["kind"], c["domain"], c["fetched"], c["level"], related=about(QUERY))
    strong = rules.is_strong(c["kind"], c["domain"], c["fetched"], c["level"], c["trusted"])
    return sources(spark, sf_dir).select("ord", ok.alias("citable"), strong.alias("strong"))


# --- feeds ----------------------------------------------------------------------------------------------------------

_FEED = "SELECT event_id, ts, event_type AS title, 'source' || user_id % 7 AS source, props AS summary FROM events"
_FW = terms(lit("latest purchase news source3"), "[a-z0-9][a-z0-9.+-]+", T.STOP_FRESH)
_DAYS = f"greatest(0.0, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 86400000000.0)"


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import events

    return events(spark, sf_dir).select("event_id", "ts", F.col("event_type").alias("title"), F.concat(F.lit("source"), (F.col("user_id") % 7).cast("string")).alias("source"), F.col("props").alias("summary"))


@query(
    "freshness_search",
    f"""WITH f AS ({_FEED}), q AS (SELECT {_FW} AS ws), s AS (SELECT event_id, ts, greatest(0.0, 20.0 - {_DAYS}) / 4 + {hits("ws", ("title", 8), ("source", 5), ("summary", 2))} AS score FROM f, q)
SELECT event_id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY s.score DESC, ts DESC, event_id LIMIT 20""",
)
def freshness_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = dates.age_days(F.col("ts"), F.lit(AS_OF))
    score = rank.freshness_score(T.fresh_terms(F.lit("latest purchase news source3")), age, F.col("title"), F.col("source"), F.col("summary"))
    out = _feed(spark, sf_dir).withColumn("s", score).filter("s > 0").orderBy(F.desc("s"), F.desc("ts"), "event_id").limit(20)
    return out.select("event_id", F.round("s", 6).alias("score"))


@query(
    "fact_rank",
    f"""WITH f AS ({_FEED}), q AS (SELECT {_FW} AS ws), s AS (SELECT event_id, ts, greatest(0.0, 30.0 - {_DAYS}) + {hits("ws", ("title", 10), ("summary", 2))} AS score FROM f, q)
SELECT event_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, event_id LIMIT 20""",
)
def fact_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = dates.age_days(F.col("ts"), F.lit(AS_OF))
    score = rank.fact_score(T.fresh_terms(F.lit("latest purchase news source3")), age, F.col("title"), F.col("summary"))
    return _feed(spark, sf_dir).withColumn("s", score).orderBy(F.desc("s"), "event_id").limit(20).select("event_id", F.round("s", 6).alias("score"))


@query("latest_items", "SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 100")
def latest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feed(spark, sf_dir).orderBy(F.desc("ts"), "event_id").limit(100).select("event_id")


@query("upsert_last_write", "SELECT props AS key, max(event_id) AS event_id FROM events GROUP BY props")
def upsert_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.keep_last(_feed(spark, sf_dir).select(F.col("summary").alias("key"), "event_id"), F.col("key"), "event_id")


@query(
    "union_by_priority",
    f"""WITH {SOURCES}, u AS (SELECT 0 AS p, ord FROM sources WHERE kind = 'trusted_news' UNION ALL SELECT 1, ord FROM sources WHERE kind = 'encyclopedia' UNION ALL SELECT 2, ord FROM sources WHERE kind = 'public_news')
SELECT p, ord FROM u ORDER BY p, ord LIMIT 30""",
)
def union_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sources(spark, sf_dir)
    parts = [d.filter(F.col("kind") == k).select(F.lit(i).alias("p"), "ord") for i, k in enumerate(("trusted_news", "encyclopedia", "public_news"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy("p", "ord").limit(30)


# --- vectors -----------------------------------------------------------------------------------------------------------

_UNIT = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), n AS (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l FROM e), u AS (SELECT vec_id, label, list_transform(v, lambda x: x / CASE WHEN l = 0 THEN 1 ELSE l END) AS v FROM n)"


def _unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", rank.l2_normalize(F.col("embedding")).alias("v"))


@query("cosine_topk", f"WITH {_UNIT} SELECT b.vec_id, round(list_inner_product(a.v, b.v), 6) AS score FROM u a, u b WHERE a.vec_id = 0 ORDER BY list_inner_product(a.v, b.v) DESC, b.vec_id LIMIT 10")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _unit(spark, sf_dir)
    one = u.filter("vec_id = 0").select(F.col("v").alias("q"))  # one row
    scored = u.join(F.broadcast(one)).withColumn("s", rank.dot(F.col("q"), F.col("v")))
    return scored.orderBy(F.desc("s"), "vec_id").limit(10).select("vec_id", F.round("s", 6).alias("score"))


@query(
    "cosine_topk_batch",
    f"""WITH {_UNIT}, s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.v, b.v) AS x FROM u a, u b WHERE a.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, vec_id) AS place FROM s)
SELECT query_id, vec_id, CAST(place AS INT) AS place FROM r WHERE place <= 10""",
)
def cosine_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 20 as a query, against all rows."""
    u = _unit(spark, sf_dir)
    queries = u.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    return rank.cosine_topk(queries, u.select("vec_id", "v"), 10).select("query_id", "vec_id", "place")


@query("vector_index_topk")
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cosine_topk_batch`` by an index: as many lists as its measured recall asks for. No SQL gives the same rows, as some neighbours are missed."""
    u = written(_unit(spark, sf_dir).select("vec_id", "v"), "unit")  # read about ten times, normalised once
    queries = u.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    index = vector_index.fit(u)
    return vector_index.search(index, queries, u, 10, vector_index.probes_for(index, queries, u, 10))


@query(
    "rank_retrieve_remainder",
    f"""WITH {_UNIT}, s AS (SELECT b.vec_id, b.label, list_inner_product(a.v, b.v) AS x FROM u a, u b WHERE a.vec_id = 0), h AS (SELECT vec_id, label FROM s ORDER BY x DESC, vec_id LIMIT 20)
SELECT vec_id, CAST(0 AS INT) AS tier, round(CAST(label AS DOUBLE), 6) AS key FROM h WHERE vec_id % 2 = 0 UNION ALL SELECT vec_id, 1, round(x, 6) FROM s WHERE vec_id IN (SELECT vec_id FROM h) AND vec_id % 2 <> 0
UNION ALL SELECT vec_id, 2, round(x, 6) FROM s WHERE vec_id NOT IN (SELECT vec_id FROM h)""",
)
def rank_retrieve_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of even vectors stand in for a model's logits."""
    u = _unit(spark, sf_dir)
    one = u.filter("vec_id = 0").select(F.col("v").alias("q"))
    scored = u.join(F.broadcast(one)).select("vec_id", rank.dot(F.col("q"), F.col("v")).alias("score"))
    logits = u.filter("vec_id % 2 = 0").select("vec_id", F.col("label").cast("double").alias("logit"))
    return rank.retrieve_then_rerank(scored, logits, 20, "vec_id").select("vec_id", F.col("tier").cast("int"), F.round("key", 6).alias("key"))
