"""Queries over the chat policies, request logs and merged results. ``asks`` are the turns of all conversations, by themselves and with questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers, rules, urls
from ..functions import policy as P
from ..operators import merge, requests, state
from .common import HOST, SOURCES, Query, events, like, lit, sources, table
from .turns import _CITABLE, _STRONG, _judged

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


ASKS = [
    "what is the capital of France?", "who is the current president of Brazil", "weather in Chennai today", "latest ipl score", "explain how photosynthesis works", "define entropy", "write a python function to sort a list", "who is the ceo of Acme",
    "plan a trip to Kyoto for 6 days", "detailed itinerary for Rome mar 3 - 9", "a short poem about rivers", "recipe for chicken biryani", "how does a rocket engine work?", "tell me more about this", "hello there", "", "12 * (3 + 4)",
    "when was the Treaty of Rome signed", "breaking news about the election with sources", "is tea good for health?", "summarize in 60 words why the sky is blue", "explain gravity in exactly 120 words", "give a brief answer: what is inflation", "at least 200 words on the Ottoman empire",
    "restaurants near the old port", "switch to tamil", "speak in hindi please", "change the language to english", "talk to telugu", "improve my resume", "summarize this document", "what about that?", "compare the earlier file", "who won the match yesterday", "price of bitcoin",
    "how much is the moon rock worth", "imagine a story of a dragon", "comprehensive plan for a visit to Peru", "vacation for two days in Goa", "what's new in spark", "market cap of Initech", "the launch date of the probe", "museums in Lisbon", "find best cafes around Green Park", "what is the text", "verify that",
]
#: Four texts a turn: what was said, a question before it, a question after it, and the question alone.
_ASKS = f"""turn_texts AS (SELECT (conv_id * 10000 + turn) * 4 AS k, coalesce(text, '') AS said, [{', '.join(lit(a) for a in ASKS)}][CAST((conv_id * 7 + turn) % {len(ASKS)} + 1 AS INT)] AS q FROM conversations),
asks AS (SELECT k + v AS id, CASE v WHEN 0 THEN said WHEN 1 THEN trim(q || ' ' || said) WHEN 2 THEN trim(said || ' ' || q) ELSE q END AS t FROM turn_texts, (SELECT unnest([0, 1, 2, 3]) AS v)), lowered AS (SELECT *, lower(t) AS low, trim(regexp_replace(lower(t), '[?!.,;:]+$', '')) AS bare FROM asks)"""


def asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, t: every turn of the conversations as it is, with one of the questions before or after it, and the question."""
    c = table(spark, sf_dir, "conversations").select(
        ((F.col("conv_id") * 10000 + F.col("turn")) * 4).alias("k"), F.coalesce("text", F.lit("")).alias("said"),
        F.element_at(F.array(*[F.lit(a) for a in ASKS]), ((F.col("conv_id") * 7 + F.col("turn")) % len(ASKS) + 1).cast("int")).alias("q"),
    )
    texts = F.array(F.col("said"), F.trim(F.concat("q", F.lit(" "), "said")), F.trim(F.concat("said", F.lit(" "), "q")), F.col("q"))
    return c.select("k", F.posexplode(texts).alias("v", "t")).select((F.col("k") + F.col("v")).alias("id"), "t")


def _any(x: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(like(x, p) for p in patterns) + ")"


_STABLE = f"(t <> '' AND ({_any('bare', [P.NAME_CAPITAL, *P.STABLE_ABOUT])} OR {_any('t', [P.SUM, *rules.CODING, P.PLAIN_QUESTION])}) AND NOT {_any('bare', P.STABLE_NOT)})"
_FACTUAL = f"(t <> '' AND NOT {like('low', P.INVENTED)} AND ({like('low', P.FACT_WORD)} OR {like('low', P.FACT_SHAPE)}))"
_DEFINITION = f"(NOT {_any('low', P.DEFINITION_NOT)} AND {_any('low', P.DEFINITION)})"
_MUTABLE = f"(t <> '' AND NOT {_STABLE} AND {_any('low', P.MUTABLE)})"
_DAYS = f"CASE regexp_extract(low, {lit(P.TRIP_DAYS)}, 1) {' '.join(f'WHEN {lit(w)} THEN {i}' for i, w in enumerate(P.NUMBERS, 1))} WHEN '' THEN 0 ELSE TRY_CAST(regexp_extract(low, {lit(P.TRIP_DAYS)}, 1) AS INT) END"
_LONG_TRIP = f"(({like('low', P.TRIP)} OR ({like('low', P.TRIP_FULL)} AND {like('low', P.TRIP_WORD)})) AND ({like('low', P.TRIP_DATES)} OR {like('low', P.TRIP_DEEP)} OR {_DAYS} >= 4))"


@query("question_kinds", f"WITH {_ASKS} SELECT id, {like('low', P.TIME_SENSITIVE)} AS time_sensitive, {_FACTUAL} AS factual, {_DEFINITION} AS definition, {_MUTABLE} AS mutable, {_STABLE} AS stable FROM lowered")
def question_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    return asks(spark, sf_dir).select("id", P.is_time_sensitive(t).alias("time_sensitive"), P.is_factual(t).alias("factual"), P.is_definition(t).alias("definition"), P.is_mutable_fact(t).alias("mutable"), P.is_stable_fact(t).alias("stable"))


#: By the question's key: title, selection, pop culture, or none.
_PURPOSE = "CASE id % 11 WHEN 0 THEN 'chat_title' WHEN 1 THEN 'selection_explain' WHEN 2 THEN 'pop_culture_reference' ELSE '' END"
_LEADER = f"{_any('t', rules.LEADER)}"
_ROUTE = [
    ("p = 'chat_title'", "direct", "chat_title_generation"), ("p = 'selection_explain'", "direct", "attachment_or_selection_grounded"), ("t = ''", "direct", "empty_query"),
    (f"p = 'pop_culture_reference' AND {like('t', P.LIVE_CULTURE)}", "live_first", "time_sensitive_query"), ("p = 'pop_culture_reference'", "direct", "pop_culture_reference_stable"),
    ("kind = 'temporal_fact'", "live_first", "temporal_fact_separator"), ("kind = 'static_reasoning' AND category <> 'general_reasoning'", "direct", None), (_STABLE, "direct", "static_general_knowledge"),
    (like("t", P.WITH_SOURCES), "live_first", "user_requested_sources"), (like("low", P.TIME_SENSITIVE), "live_first", "time_sensitive_query"), (_DEFINITION, "direct", "stable_definition_query"),
    (f"{_FACTUAL} AND {_MUTABLE}", "live_first", "mutable_factual_query"), (_FACTUAL, "direct", "stable_factual_query"),
]
_OFFICE = r"(?i)\b(president|prime minister|ceo)\s+of\b"
_INTENT = f"""CASE WHEN {like('t', rules.FIND_ONLINE)} THEN 'explicit_search' WHEN {like('t', rules.WEATHER)} OR {like('t', rules.FINANCE)} THEN 'domain_specific'
WHEN {like('t', rules.CAPITAL)} AND NOT {like('t', rules.FRESH)} THEN 'static_reasoning' WHEN {like('t', _OFFICE)} OR {_LEADER} THEN 'temporal_fact' ELSE 'static_reasoning' END"""
_CATEGORY = f"""CASE WHEN {like('t', rules.CAPITAL)} AND NOT {like('t', rules.FRESH)} THEN 'stable_geographic_fact' WHEN {_any('t', rules.CODING)} THEN 'coding' WHEN {_any('t', rules.MATHS)} THEN 'mathematics'
WHEN {_any('t', rules.CREATIVE)} THEN 'conceptual_or_creative' ELSE 'general_reasoning' END"""


@query(
    "chat_routes",
    f"""WITH {_ASKS}, i AS (SELECT *, {_PURPOSE} AS p, {_INTENT} AS kind, {_CATEGORY} AS category FROM lowered),
r AS (SELECT id, CASE {" ".join(f"WHEN {c} THEN {lit(a)}" for c, a, _ in _ROUTE)} ELSE 'direct' END AS strategy, CASE {" ".join(f"WHEN {c} THEN {lit(b) if b else chr(39) + 'static_' + chr(39) + ' || category'}" for c, _, b in _ROUTE)} ELSE 'casual_or_non_factual' END AS reason FROM i)
SELECT *, strategy <> 'direct' AS web FROM r""",
)
def chat_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id") % 11
    purpose = F.when(k == 0, "chat_title").when(k == 1, "selection_explain").when(k == 2, "pop_culture_reference").otherwise("")
    return asks(spark, sf_dir).select("id", P.routing(F.col("t"), purpose).alias("r")).select("id", "r.strategy", "r.reason", "r.web")


_WORDS = "CAST(coalesce(nullif(regexp_extract(low, 'exactly (\\d+) words', 1), ''), nullif(regexp_extract(low, 'at least (\\d+) words', 1), ''), nullif(regexp_extract(low, 'in (\\d+) words', 1), '')) AS INT)"
_STYLE = "['balanced', 'witty', 'chatty', 'supportive', 'debate', 'odd'][CAST(id % 6 + 1 AS INT)]"
_P2 = "['', 'verify_answer', 'fast_explainer', 'chat_title', ''][CAST(id % 5 + 1 AS INT)]"


@query(
    "length_policies",
    f"""WITH {_ASKS}, a AS (SELECT *, {_P2} AS p, {_STYLE} AS style, id % 13 = 0 AS structured, CASE WHEN low LIKE '%at least%' THEN CAST(floor({_WORDS} * 1.5 + 0.5) AS INT) ELSE {_WORDS} END AS high FROM lowered),
d AS (SELECT *, CASE WHEN high <= 80 OR {like("low", P.BRIEF)} THEN 'short' ELSE 'detailed' END AS detail FROM a),
k AS (SELECT *, CASE WHEN p = 'chat_title' THEN 'title' WHEN structured THEN 'structured' WHEN high IS NOT NULL THEN 'words' WHEN p = 'fast_explainer' THEN 'explainer' WHEN {like("low", P.RECIPE[0])} AND {like("low", P.RECIPE[1])} THEN 'recipe'
 WHEN {_LONG_TRIP} THEN 'trip' WHEN detail = 'short' THEN 'short' ELSE 'detailed' END AS kind FROM d),
m AS (SELECT *, CASE kind WHEN 'title' THEN 120 WHEN 'structured' THEN 2000 WHEN 'words' THEN CAST(least(16000, greatest(600, floor(high * 2.6::DOUBLE + 400.5))) AS INT) WHEN 'explainer' THEN 2000 WHEN 'recipe' THEN 10000 WHEN 'trip' THEN 14000 WHEN 'short' THEN 2000 ELSE 12000 END AS tokens,
 CASE WHEN kind = 'words' THEN CASE WHEN high <= 80 THEN 'short' ELSE 'detailed' END WHEN kind = 'explainer' THEN 'short' ELSE detail END AS level,
 CASE style WHEN 'witty' THEN 0.88 WHEN 'chatty' THEN 0.82 WHEN 'supportive' THEN 0.72 WHEN 'debate' THEN 0.78 ELSE 0.6 END::DOUBLE AS base FROM k)
SELECT id, kind, CAST(tokens AS INT) AS max_tokens, CASE WHEN kind IN ('title', 'structured') OR p IN ('chat_title', 'verify_answer') THEN 0.2 WHEN p = 'fast_explainer' THEN 0.4 WHEN {like("low", P.CREATIVE)} THEN 0.92 WHEN {like("low", P.FACTUAL)} THEN 0.35 WHEN level = 'short' THEN least(base, 0.5) ELSE base END::DOUBLE AS temperature,
 CAST(least(greatest(256, tokens), CASE WHEN p IN ('fast_explainer', 'chat_title') THEN 2500 WHEN id % 2 = 0 THEN 8000 ELSE 10000 END) AS INT) AS capped FROM m""",
)
def length_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    of = lambda xs, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % n + 1).cast("int"))
    a = asks(spark, sf_dir).withColumns({"p": of(["", "verify_answer", "fast_explainer", "chat_title", ""], 5), "style": of(["balanced", "witty", "chatty", "supportive", "debate", "odd"], 6)})
    out = a.withColumn("l", P.length_policy(F.col("t"), F.col("p"), F.col("style"), F.lit(""), k % 13 == 0))
    return out.select("id", "l.kind", "l.max_tokens", "l.temperature", P.cost_cap(F.col("l.max_tokens"), F.col("p"), k % 2 == 0, 2500, 8000, 10000).alias("capped"))


_SPEAK = " ".join(f"WHEN {like('low', P.SPEAK_IN + name + chr(92) + 'b')} OR {like('low', native)} THEN {lit(code)}" for code, name, native in P.LANGUAGES)
_KIND = "CASE id % 3 WHEN 0 THEN 'attachment' WHEN 1 THEN 'vision' ELSE '' END"
_FOLLOWS = f"""(length(t) BETWEEN 1 AND 320 AND ({like('t', P.SEEN_BARE)} OR {like('t', P.FILE_BARE)} OR (k IN ('attachment', 'vision') AND ({like('t', P.FILE_NAMED)} OR ({like('t', P.IMPROVE)} AND {_any('t', P.IMPROVED)})
 OR (k = 'vision' AND {like('t', P.PICTURE)}) OR (k = 'attachment' AND {like('t', P.FILE_ASK)} AND {like('t', P.FILE_POINT)}) OR ({like('t', '(?i)' + chr(92) + 'b(this|that|it)' + chr(92) + 'b')} AND length(t) <= 160)))))"""


@query("chat_commands", f"WITH {_ASKS}, a AS (SELECT *, {_KIND} AS k FROM lowered) SELECT id, CASE {_SPEAK} END AS locale, {_FOLLOWS} AS follows FROM a")
def chat_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.when(F.col("id") % 3 == 0, "attachment").when(F.col("id") % 3 == 1, "vision").otherwise("")
    return asks(spark, sf_dir).select("id", P.language_command(F.col("t")).alias("locale"), P.is_seen_follow_up(F.col("t"), k).alias("follows"))


_CITIES = ["Chennai", "New Delhi", "Port Blair", "Lisbon", "Rio de Janeiro"]
_CITY = f"[{', '.join(lit(c) for c in _CITIES)}][CAST(o_custkey % {len(_CITIES)} + 1 AS INT)]"


@query("asked_places", f"SELECT o_orderkey AS id, {_CITY} AS location, CASE WHEN o_orderkey % 2 = 0 THEN {_CITY} ELSE 'quiet parks ' || o_custkey END AS place FROM orders")
def asked_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    city = F.element_at(F.array(*[F.lit(c) for c in _CITIES]), (F.col("o_custkey") % len(_CITIES) + 1).cast("int"))
    even = F.col("o_orderkey") % 2 == 0
    asked = F.when(even, F.concat(F.lit("show me best parks in "), city, F.lit(" today"))).otherwise(F.concat(F.lit("find quiet  parks "), F.col("o_custkey")))
    weather = F.concat(F.lit("current weather  in "), city, F.lit("?"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), P.location_in(weather).alias("location"), P.place_asked(asked).alias("place"))


_SAID = ["Likely accurate, as it stands", "incorrect by a year", "Unsupported claim", "partly accurate only", "OUTDATED since", "no label here"]
_LABEL = ["Accurate", "Inaccurate", "Unverified", "Misleading", "Outdated", ""]
_LEFT = [", as it stands", " by a year", " claim", " only", " since", ""]


@query(
    "verdict_reports",
    f"""WITH o AS (SELECT o_orderkey AS id, CAST(o_orderkey % 6 + 1 AS INT) AS k, o_orderkey % 4 > 0 AS held, o_orderkey % 5 = 0 AS now, o_custkey AS c FROM orders),
v AS (SELECT *, [{", ".join(lit(x) for x in _LABEL)}][k] AS label, [{", ".join(lit(x) for x in _LEFT)}][k] AS rest, CASE WHEN now THEN chr(10) || 'It is so today.' ELSE chr(10) || 'It was so.' END AS tail, CASE WHEN held THEN '1. [Page ' || c || '](https://s' || c || '.org/a)' END AS link FROM o)
SELECT id, CASE WHEN label = '' THEN 'Verdict: Unverified.' || chr(10) || 'no label here' ELSE 'Verdict: ' || CASE WHEN now AND NOT held THEN 'Unverified' ELSE label END || rest END || tail AS verdict,
 'How checked: by hand ' || c || chr(10) || 'Sources used: ' || coalesce(link, 'No retrieved sources were available.') AS report,
 CASE WHEN k = 1 THEN '' WHEN k = 2 THEN 'Fine ' || c || '.' ELSE 'Fine ' || c || '.' END AS answer FROM v""",
)
def verdict_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key, c = F.col("o_orderkey"), F.col("o_custkey")
    said = F.element_at(F.array(*[F.lit(x) for x in _SAID]), (key % 6 + 1).cast("int"))
    tail = F.when(key % 5 == 0, "\nIt is so today.").otherwise("\nIt was so.")
    verdict = F.concat(F.when(key % 6 == 5, said).otherwise(F.concat(F.lit("Verdict: "), said)), tail)
    link = F.struct(F.concat(F.lit("Page  "), c).alias("title"), F.concat(F.lit("https://s"), c, F.lit(".org/a")).alias("url"))
    held = F.when(key % 4 > 0, F.array(link)).otherwise(F.array(F.struct(F.lit("local").alias("title"), F.lit("file:///x").alias("url"))))
    report = F.concat(F.lit("Verdict: Accurate\nHow checked: by  hand "), c, F.lit("\nSources: old ones\nand more"))
    answer = F.when(key % 6 == 0, "Please check the official website.").when(key % 6 == 1, F.concat(F.lit("Fine  "), c, F.lit("."))).otherwise(F.concat(F.lit(" Fine "), c))
    return o.select(key.alias("id"), P.verdict_labels(verdict, key % 4 > 0).alias("verdict"), P.compact_report(report, held).alias("report"), P.sanitized(answer).alias("answer"))


@query(
    "update_lines",
    """WITH o AS (SELECT o_orderkey AS id, o_orderkey % 4 AS k, o_custkey AS c, strftime(o_orderdate, '%d') AS d, year(o_orderdate) AS y, ['January','February','March','April','May','June','July','August','September','October','November','December'][month(o_orderdate)] AS mo FROM orders)
SELECT id, CASE k WHEN 0 THEN 'the reported date is ' || mo || ' ' || d || ', ' || y || ' (Probe ' || c || ' lands).' WHEN 1 THEN 'I could not confirm an exact date from the top live snippets.' WHEN 2 THEN 'Probe ' || c || ' lands. A long first sentence about the landing.' ELSE 'the latest update is: Probe ' || c || ' lands.' END AS line,
 CASE k WHEN 0 THEN 'NASA EONET' WHEN 1 THEN NULL WHEN 2 THEN 'cached' ELSE 'plain' END AS shape FROM o""",
)
def update_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey")
    day = F.date_format("o_orderdate", "MMMM dd, yyyy")
    title = F.concat(F.lit("Probe "), c, F.lit(" lands."))
    lead = F.when(k == 2, "A long first sentence about the landing. More of it.").otherwise("Soon. Later.")
    asked = F.when(k < 2, "When did it land?").otherwise("news of the probe")
    other = F.struct(F.lit("x").alias("title"), F.when(k == 0, F.concat(F.lit("It landed on "), day)).otherwise("no date").alias("description"))
    kind = F.when(k == 0, "free_disaster_event").when(k == 1, "blog").when(k == 2, "cached_latest").otherwise("encyclopedia")
    given = P.source_answer(kind, title, lead, F.lit("2024-01-05T00:00:00Z"), F.lit("Feed"))
    shape = F.when(given["answer"].endswith("(2024-01-05): Soon. Later."), "NASA EONET").when(F.contains(given["answer"], F.lit("lands. (Feed): A long")), "cached").when(given["provider"] == "public_source_result", "plain")
    return o.select(F.col("o_orderkey").alias("id"), P.update_line(asked, title, lead, F.array(other)).alias("line"), shape.alias("shape"))


_HOUR = 3_600_000
_METHOD, _TYPE = "['POST', 'GET', 'OPTIONS', 'POST', 'POST', 'POST'][CAST(event_id % 6 + 1 AS INT)]", "CASE WHEN event_id % 7 = 0 THEN 'text/plain' ELSE 'application/json; charset=utf-8' END"


@query(
    "request_admission",
    f"""WITH RECURSIVE l AS (SELECT event_id, user_id, epoch_ms(ts) AS t, CASE WHEN event_id % 19 = 0 THEN 403 WHEN {_METHOD} = 'OPTIONS' THEN 200 WHEN {_METHOD} <> 'POST' THEN 405 WHEN event_id % 7 = 0 THEN 415 WHEN event_id % 17 = 0 THEN 413 WHEN {like("props", rules.ABUSE_MARKUP)} THEN 400 END AS status FROM events),
e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS r FROM l WHERE status IS NULL),
w AS (SELECT user_id, event_id, r, 1 AS n, t + {48 * _HOUR} AS until FROM e WHERE r = 1 UNION ALL SELECT e.user_id, e.event_id, e.r, CASE WHEN w.until <= e.t THEN 1 ELSE w.n + 1 END, CASE WHEN w.until <= e.t THEN e.t + {48 * _HOUR} ELSE w.until END FROM w JOIN e ON e.user_id = w.user_id AND e.r = w.r + 1),
s AS (SELECT l.event_id, coalesce(l.status, CASE WHEN w.n > 2 THEN 429 END) AS status FROM l LEFT JOIN w USING (event_id))
SELECT event_id, CAST(status AS INT) AS status, CASE status {" ".join(f"WHEN {k} THEN {lit(v)}" for k, v in requests.ERRORS.items())} END AS error FROM s""",
)
def request_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    log = events(spark, sf_dir).withColumns(
        {
            "method": F.element_at(F.array(*[F.lit(x) for x in ("POST", "GET", "OPTIONS", "POST", "POST", "POST")]), (n % 6 + 1).cast("int")),
            "content_type": F.when(n % 7 == 0, "text/plain").otherwise("application/json; charset=utf-8"),
            "n_bytes": F.when(n % 17 == 0, 2_000_000).otherwise(100),
            "body": F.col("props"),
            "origin_ok": n % 19 != 0,
        }
    )
    return requests.admit(log, "user_id", F.col("ts"), "event_id", 2, 48 * _HOUR)


@query(
    "request_paths",
    """WITH p AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '^https?://[^/?#]*', ''), '[?#].*$', '') AS bare FROM pages)
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '/api/search' ELSE coalesce(nullif(regexp_replace(regexp_replace('/' || bare, '/+', '/', 'g'), '/$', ''), ''), '/') END AS path, CAST(CASE WHEN page_id % 3 = 0 THEN 200 ELSE 404 END AS INT) AS status,
 CASE page_id % 4 WHEN 0 THEN '10.0.0.' || page_id % 200 WHEN 1 THEN '192.168.1.' || page_id % 200 WHEN 2 THEN 'socket' ELSE 'unknown' END AS ip FROM p""",
)
def request_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    path = requests.request_path(F.when(n % 3 == 0, "//api//search/?q=1").otherwise(" "), F.col("url"))
    ip = requests.client_ip(
        F.when(n % 4 == 0, F.concat(F.lit(" 10.0.0."), n % 200, F.lit(", 10.9.9.9"))), F.when(n % 4 == 1, F.concat(F.lit("192.168.1."), n % 200)), F.when(n % 4 == 2, "socket")
    )
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), ip.alias("ip")).select("page_id", "path", requests.route_of(F.col("path"), ["/api/search"], ["/api/old"])["status"].alias("status"), "ip")


@query(
    "rerank_merged",
    f"""WITH {SOURCES}, r AS (SELECT ord % 40 AS query_id, ord, url, title, row_number() OVER (PARTITION BY ord % 40 ORDER BY ord) AS n FROM sources),
k AS (SELECT query_id, ord, coalesce(nullif(trim(url), ''), title) AS key, CASE WHEN ord % 3 = 0 THEN -ord END AS place FROM r),
f AS (SELECT * FROM k WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY place IS NULL, coalesce(place, ord), ord) = 1)
SELECT query_id, ord, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place IS NULL, coalesce(place, ord), ord) AS INT) AS position FROM f""",
)
def rerank_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge that puts every third source of a query first, the last of them foremost."""
    rows = sources(spark, sf_dir).withColumn("query_id", F.col("ord") % 40)
    ranked = rows.filter("ord % 3 = 0").select("query_id", "ord", (-F.col("ord")).alias("place"))
    return merge.rerank_merge(rows, ranked, "query_id", "ord")


@query(
    "picked_sources",
    f"""WITH {SOURCES}, r AS (SELECT ord % 40 AS query_id, ord, description, row_number() OVER (PARTITION BY ord % 40 ORDER BY ord DESC) AS place FROM sources)
SELECT query_id, ord, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place) AS INT) AS position, CASE WHEN ord % 5 = 1 THEN 'kept for ' || ord ELSE description END AS description FROM r WHERE ord % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY place) <= 8""",
)
def picked_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge that goes backwards, names each source twice, and calls every fourth irrelevant."""
    n = F.col("ord")
    rows = sources(spark, sf_dir).withColumn("query_id", n % 40)
    picks = rows.select("query_id", "ord", F.when(n % 4 == 0, "Irrelevant").otherwise("weak").alias("relevance"), F.when(n % 5 == 1, F.concat(F.lit("kept for "), n)).alias("said"), F.explode(F.array(-n, 1_000_000 - n)).alias("place"))
    return merge.picked(rows.select("query_id", "ord", "description"), picks, "query_id", "ord")


@query(
    "evidence_phases",
    f"""WITH {SOURCES}, j AS (SELECT ord % 40 AS query_id, ord, ord % 3 + 1 AS phase, lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '')) AS key, domain, date, {_STRONG} AS strong, lower(CASE WHEN description <> '' THEN description ELSE title END) AS said FROM sources WHERE {_CITABLE}),
f AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY phase, ord) = 1),
g AS (SELECT query_id, p AS phase, count(*) AS n_evidence, count(DISTINCT nullif(domain, '')) AS n_domains, bool_or(strong) AS strong, bool_or(trim(date) <> '') AS dated,
 coalesce(bool_or({like("said", rules.FORMER)}) AND bool_or({like("said", rules.PRESENT)}) AND count(*) FILTER (said <> '') >= 2, false) AS conflict FROM f, (SELECT unnest([1, 2, 3]) AS p) WHERE phase <= p GROUP BY 1, 2),
c AS (SELECT *, least(0.99, CASE WHEN strong THEN 0.74 ELSE 0.0 END + CASE WHEN n_domains >= 2 THEN 0.16 ELSE 0.0 END + CASE WHEN dated THEN 0.05 ELSE 0.0 END) AS raw, NOT conflict AND (strong OR n_domains >= 2) AS pass FROM g)
SELECT query_id, CAST(phase AS INT) AS phase, pass, CAST(round(CASE WHEN pass THEN greatest(0.86, raw) ELSE least(0.6, raw) END, 2) AS DOUBLE) AS confidence, n_evidence FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY NOT pass, CASE WHEN pass THEN phase ELSE -phase END) = 1""",
)
def evidence_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources dealt over three phases of a search; each query stops where its evidence is enough."""
    rows = _judged(spark, sf_dir).filter("evidence").withColumn("phase", (F.col("ord") % 3 + 1).cast("int"))
    return merge.phased(rows, "query_id", "ord", 3)


_PROVIDERS = [("pages", 5), ("encyclopedia", 4), ("entities", 3), ("discussion", 3), ("news", 8)]


@query(
    "lateral_queries",
    f"""WITH p AS (SELECT unnest([{", ".join(lit(p) for p, _ in _PROVIDERS)}]) AS provider, unnest([{", ".join(str(n) for _, n in _PROVIDERS)}]) AS most) SELECT n_nationkey, provider, CAST(most AS INT) AS most FROM nation, p""",
)
def lateral_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.lateral(table(spark, sf_dir, "nation").select("n_nationkey"), _PROVIDERS)


@query(
    "filter_with_fallback",
    "WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice > 250000 AS want, o_orderstatus = 'F' AS spare FROM orders), g AS (SELECT *, bool_or(want) OVER (PARTITION BY o_custkey) AS found FROM o) SELECT o_custkey, o_orderkey FROM g WHERE CASE WHEN found THEN want ELSE spare END",
)
def filter_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    return merge.filter_or(o, "o_custkey", F.col("o_totalprice") > 250_000, F.col("o_orderstatus") == "F").select("o_custkey", "o_orderkey")


@query("turn_retention", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3 AND NOT (turn % 5 = 2 OR conv_id % 7 = 0 AND turn % 2 = 1)")
def turn_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three turns of each conversation, without discarded and aborted ones."""
    t = table(spark, sf_dir, "conversations").withColumns({"id": F.concat_ws(":", "conv_id", "turn"), "turn_id": F.col("turn")})
    t = t.withColumn("status", F.when((F.col("conv_id") % 7 == 0) & (F.col("turn") % 2 == 1), "Aborted"))
    gone = t.filter("turn % 5 = 2").select("conv_id", F.when(F.col("conv_id") % 2 == 0, F.col("id")).otherwise(F.col("turn_id").cast("string")).alias("discarded"))
    return merge.retract(merge.recorded(merge.retained(t, 1)), gone).select("conv_id", "turn")


_GATE = "e AS (SELECT event_type, event_id, epoch_ms(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events)"


@query(
    "refresh_gate",
    f"""WITH RECURSIVE {_GATE}, w AS (SELECT event_type, event_id, r, true AS refresh, t + {24 * _HOUR} AS until FROM e WHERE r = 1 UNION ALL
SELECT e.event_type, e.event_id, e.r, w.until <= e.t, CASE WHEN w.until > e.t THEN w.until ELSE e.t + {24 * _HOUR} END FROM w JOIN e ON e.event_type = w.event_type AND e.r = w.r + 1) SELECT event_id AS id, refresh FROM w""",
)
def refresh_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that find the last refresh of their cache a day old renew it; the others wait."""
    asked = events(spark, sf_dir)
    return state.ttl_cache(asked, "event_type", F.col("ts"), F.col("event_id"), 24 * _HOUR).select("id", (~F.col("hit")).alias("refresh"))


@query(
    "result_rows",
    f"""SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')) AS title, regexp_replace(url, '#.*$', '') AS url, {HOST} AS domain, CASE WHEN page_id % 2 = 0 THEN 'news ' || page_id ELSE {HOST} END AS label, CASE WHEN page_id % 3 = 0 THEN 'cached_recent' ELSE 'cached' END AS freshness FROM pages""",
)
def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as rows of a feed cache, as results."""
    from ..functions.text import first_tag, strip_tags

    n = F.col("page_id")
    p = table(spark, sf_dir, "pages").select(
        "page_id", strip_tags(first_tag(F.col("html"), "h1")).alias("title"), "url", F.when(n % 2 == 0, F.concat(F.lit("news "), n)).otherwise(" ").alias("source"), F.when(n % 3 == 0, "2024-01-05").otherwise("").alias("published")
    )
    host = urls.host(F.col("url"))
    label = F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.nullif(host, F.lit("")), F.lit("Latest cache"))
    return p.select("page_id", F.trim("title").alias("title"), urls.normalize(F.col("url")).alias("url"), host.alias("domain"), label.alias("label"), F.when(F.col("published") != "", "cached_recent").otherwise("cached").alias("freshness"))


_PLEASE = "Please share the sources you want me to check"
_ANSWERED = f"CASE id % 3 WHEN 0 THEN {lit(_PLEASE)} WHEN 1 THEN '' ELSE 'So it is.' END"


@query(
    "live_policies",
    f"""WITH {_ASKS}, a AS (SELECT *, {_ANSWERED} AS answer, id % 2 AS n, CASE WHEN id % 5 = 0 THEN 'live_first' ELSE 'direct' END AS strategy, id % 7 < 3 AS tried FROM lowered), b AS (SELECT *, ({_any("lower(answer)", answers.ASKS_SOURCES)} AND NOT {like("lower(answer)", answers.PORTFOLIO)}) AS sent FROM a)
SELECT id, CASE WHEN {_STABLE} THEN 'keep' WHEN strategy = 'direct' AND NOT tried AND n = 0 THEN 'keep' WHEN sent AND n > 0 THEN 'live_update' WHEN sent AND (tried OR strategy = 'live_first') THEN 'unavailable' WHEN sent OR NOT {like("low", P.TIME_SENSITIVE)} THEN 'keep' WHEN n > 0 THEN 'live_update' WHEN tried AND answer = '' THEN 'unavailable' ELSE 'keep' END AS policy FROM b""",
)
def live_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    answer = F.when(k % 3 == 0, _PLEASE).when(k % 3 == 1, "").otherwise("So it is.")
    return asks(spark, sf_dir).select("id", P.live_policy(F.col("t"), answer, k % 2, F.when(k % 5 == 0, "live_first").otherwise("direct"), k % 7 < 3).alias("policy"))
