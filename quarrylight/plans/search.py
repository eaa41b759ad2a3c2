"""Whole searches composed of the operators, and joins over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers, rules, urls
from ..functions import text as T
from ..operators import chunk, joins, rank
from .common import STRIP, QUERY, SOURCES, Query, hits, like, lit, sources, table, terms
from .texts import _KEY, _T1, _WS, about
from .turns import _CITABLE, _STRONG

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


@query(
    "verified_search",
    f"""WITH {SOURCES}, k AS (SELECT *, {_KEY} AS key FROM sources), u AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord) = 1), q AS (SELECT {_WS} AS ws),
c AS (SELECT * FROM u WHERE {_CITABLE}) SELECT ord, url, CAST({_T1} AS INT) AS score, {_STRONG} AS strong FROM c, q ORDER BY score DESC, ord LIMIT 10""",
)
def verified_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dedupe by canonical URL, keep what may be cited, rank, take ten."""
    c = {n: F.col(n) for n in ("title", "url", "description", "kind", "domain", "fetched", "level", "trusted", "date")}
    rows = rank.keep_first(sources(spark, sf_dir), urls.canonical_key(F.col("url")), "ord")
    ok = rules.is_citation(F.lit(QUERY), c["title"], c["url"], c["description"], c["kind"], c["domain"], c["fetched"], c["level"], related=about(QUERY))
    score = rank.source_score(T.query_terms(F.lit(QUERY)), *[c[n] for n in ("title", "description", "domain", "kind", "level", "trusted", "date")])
    out = rows.filter(ok).select("ord", "url", score.cast("int").alias("score"), rules.is_strong(c["kind"], c["domain"], c["fetched"], c["level"], c["trusted"]).alias("strong"))
    return out.orderBy(F.desc("score"), "ord").limit(10)


_AT = "CASE WHEN length(p) < 1200 THEN length(p) WHEN instr(reverse(p), ' ') = 0 THEN -1 ELSE 1200 - instr(reverse(p), ' ') END"
_LONG = f"trim({STRIP})"


@query(
    "best_chunk_join",
    f"""WITH RECURSIVE {SOURCES}, c0 AS (SELECT ord, trim(regexp_replace(concat_ws('. ', nullif(title, ''), nullif(description, ''), nullif(body, '')), '\\s+', ' ', 'g')) AS t FROM sources JOIN (SELECT page_id AS ord, {_LONG} AS body FROM pages) USING (ord)),
walk AS (SELECT ord, 1 AS i, 0 AS k FROM c0 UNION ALL SELECT ord, greatest(i + w - 160, i + 1), k + 1 FROM (SELECT ord, i, k, n, CASE WHEN a > 660.0 THEN a + 1 ELSE length(p) END AS w FROM (SELECT *, {_AT} AS a FROM (SELECT walk.ord, i, k, length(t) AS n, substring(t, i, 1200) AS p FROM walk JOIN c0 USING (ord))))
 WHERE i + w - 1 < n),
cut AS (SELECT ord, k, trim(substring(t, i, CASE WHEN a > 660.0 THEN a + 1 ELSE length(p) END)) AS chunk FROM (SELECT *, {_AT} AS a FROM (SELECT walk.ord, t, i, k, substring(t, i, 1200) AS p FROM walk JOIN c0 USING (ord)))),
q AS (SELECT {_WS} AS ws), s AS (SELECT ord, k, chunk, {hits("ws", ("chunk", 1))} AS n FROM cut, q WHERE chunk <> ''), b AS (SELECT * FROM s WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY ord ORDER BY n DESC, k) = 1)
SELECT sources.ord, CAST(coalesce(n, 0) AS INT) AS score, coalesce(chunk, description) AS text FROM sources LEFT JOIN b ON sources.ord = b.ord""",
)
def best_chunk_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source with its best chunk of the whole page, or its description where no chunk holds a query word."""
    d = sources(spark, sf_dir)
    said = F.array_join(F.filter(F.array("title", "description", "text"), lambda x: x != ""), ". ")
    parts = chunk.explode_chunks(d.select("ord", said.alias("text")), "text", 1200, most=None)
    words = T.query_terms(F.lit(QUERY))
    low = F.lower("chunk")
    scored = parts.withColumn("n", F.size(F.filter(words, lambda w: F.contains(low, w)))).filter("n > 0")
    best = scored.groupBy("ord").agg(F.max(F.struct("n", (-F.col("chunk_index")).alias("i"), "chunk")).alias("b"))
    return d.join(best, "ord", "left").select("ord", F.coalesce("b.n", F.lit(0)).alias("score"), F.coalesce("b.chunk", "description").alias("text"))


_PORTAL = ", ".join(f"({lit(a)}, {lit(u)}, {lit(p)})" for a, u, p in joins.PORTALS)


@query("official_portals", f"WITH p AS (SELECT * FROM (VALUES {_PORTAL}) v(label, url, pattern)) SELECT n_nationkey, label, url FROM nation, p WHERE regexp_matches('latest from the ' || ['united states', 'uk', 'india', 'canada', 'nowhere', 'france and germany', 'japan', 'south africa'][n_nationkey % 8 + 1] || ' please', pattern)")
def official_portals(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = F.array(*[F.lit(x) for x in ("united states", "uk", "india", "canada", "nowhere", "france and germany", "japan", "south africa")])
    asked = F.concat(F.lit("latest from the "), F.element_at(places, (F.col("n_nationkey") % 8 + 1).cast("int")), F.lit(" please"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(joins.portals(asked)).alias("p")).select("n_nationkey", "p.label", "p.url")


@query(
    "answer_sources",
    f"""WITH {SOURCES} SELECT ord, CASE WHEN kind IN ('archive_lookup', 'community_discussion') THEN false WHEN {like("lower(title || ' ' || url)", answers.SEARCH_URL)} OR {like("domain", answers.ARCHIVES)} THEN false
WHEN level = 'structured_claim' OR kind = 'official_source' THEN true WHEN kind = 'reference_lookup' THEN length(description) >= 40 OR length(title) >= 12
WHEN kind IN ('trusted_news', 'public_news', 'encyclopedia') THEN length(description) >= 12 OR length(title) >= 8 ELSE length(description) >= 20 OR length(title) >= 12 END AS usable,
NOT {like("url", r"(?i)\.pdf(?:$|[?#])")} AS crawlable FROM sources""",
)
def answer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = answers.is_answer_source(*[F.col(c) for c in ("title", "url", "description", "kind", "domain", "level")])
    return sources(spark, sf_dir).select("ord", ok.alias("usable"), answers.is_crawlable(F.col("url")).alias("crawlable"))


@query(
    "semi_join_fallback",
    """WITH r AS (SELECT o_custkey, o_orderkey, o_orderpriority FROM orders), k AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_totalprice > 300000), h AS (SELECT r.*, k.o_custkey IS NOT NULL AS hit FROM r LEFT JOIN k ON r.o_custkey = k.o_custkey AND r.o_orderpriority = k.o_orderpriority),
g AS (SELECT *, bool_or(hit) OVER (PARTITION BY o_custkey) AS any_hit FROM h) SELECT o_custkey, o_orderkey FROM g WHERE hit OR NOT any_hit""",
)
def semi_join_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer with a priority the customer also paid much for; all of them where there is none."""
    o = table(spark, sf_dir, "orders")
    keys = o.filter("o_totalprice > 300000").select("o_custkey", "o_orderpriority")
    return joins.semi_or_all(o.select("o_custkey", "o_orderkey", "o_orderpriority"), keys, "o_orderpriority", "o_custkey").select("o_custkey", "o_orderkey")


@query(
    "source_block",
    f"""WITH {SOURCES}, r AS (SELECT ord % 40 AS query_id, ord, title, url, row_number() OVER (PARTITION BY ord % 40 ORDER BY ord) AS n FROM sources) SELECT query_id, string_agg(title || ' ' || url, chr(10) ORDER BY n) AS block FROM r WHERE n <= 6 GROUP BY query_id""",
)
def source_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sources(spark, sf_dir).withColumn("query_id", F.col("ord") % 40)
    return joins.concatenated(d, "query_id", "ord", F.concat_ws(" ", F.col("title"), F.col("url")))
