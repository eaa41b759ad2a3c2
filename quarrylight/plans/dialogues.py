"""Queries over the dialogue rules: routes, failures, places, targets, source lists, spoken science, threads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dialogue as D
from ..operators import threads
from .common import SOURCES, Query, like, lit, sources, sub, table
from .turns import _MESSAGES, messages, turns

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


_CALM = f"trim({sub(sub(sub('lower(t)', ('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}' + chr(92) + 's' + chr(39) + ']', ' ')), (D.FILLER, ' ')), (chr(92) + 's+', ' '))})"
_CASUAL = f"(calm <> '' AND ({like('calm', D.GREETING)} OR {like('calm', D.HOW_ARE_YOU)} OR {like('calm', D.THANKS)}))"
_SIMPLE = f"(length(t) BETWEEN 1 AND 160 AND NOT ({like('t', D.LIVE)} OR {like('t', D.SAFETY)} OR {like('t', D.PLACE)} OR {like('t', D.ROLE)}) AND ({like('t', D.STABLE)} OR {like('t', D.CAPABILITY)} OR ({like('t', D.SHORT_EXPLAINER)} AND length(t) <= 120)))"
_FRONT = [
    ("t = ''", "clarify", "empty_message"), (_CASUAL, "fast_simple", "casual_conversation"), (f"length(t) <= 120 AND {like('t', D.JOKE)}", "fast_simple", "joke_request"), (f"length(t) <= 180 AND {like('t', D.TRANSFORM)}", "fast_simple", "transform_request"),
    (like("t", D.SAFETY), "safety_sensitive", "safety_sensitive_query"), (like("t", D.PLACE), "place_grounded", "place_query_requires_evidence"), (like("t", D.LIVE), "live_required", "source_or_freshness_required"), (_SIMPLE, "fast_simple", "simple_stable_question"),
]


@query(
    "front_routes",
    f"""WITH {_MESSAGES}, a AS (SELECT conv_id, turn, {sub("coalesce(text, '')", (r"^\s+|\s+$", ""))} AS t FROM messages), b AS (SELECT *, {_CALM} AS calm FROM a)
SELECT conv_id, turn, CASE {" ".join(f"WHEN {c} THEN {lit(r)}" for c, r, _ in _FRONT)} ELSE 'chat_direct' END AS route, CASE {" ".join(f"WHEN {c} THEN {lit(w)}" for c, _, w in _FRONT)} ELSE 'default_direct_chat' END AS reason FROM b""",
)
def front_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("conv_id", "turn", D.front_route(F.col("text")).alias("r")).select("conv_id", "turn", "r.route", "r.reason")


_ERRORS = ["Error network timeout", "AbortError: stopped", "camera denied", "no usable results", "blank response", "HTTP 503", "odd thing"]


@query("failure_classes", "SELECT event_id, ['network_timeout', 'aborted', 'permission_blocked', 'retrieval_empty', 'model_empty', 'network_timeout', 'unknown'][event_id % 7 + 1] AS code FROM events")
def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.element_at(F.array(*[F.lit(e) for e in _ERRORS]), (F.col("event_id") % len(_ERRORS) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", D.failure(text).alias("code"))


_ASK = "find the Thention erthe museum"


def _topic(x: str) -> str:
    return f"trim({sub(sub(sub(f'lower({x})', ('<[^>]*>', ' ')), ('[^a-z0-9' + chr(92) + 's' + chr(39) + '-]', ' ')), (D.PLACE_STOP, ' '), (chr(92) + 's+', ' '))})"


@query(
    "place_evidence",
    f"""WITH {SOURCES}, p AS (SELECT ord, {_topic(lit(_ASK))} AS topic, {_topic("title")} AS title, {_topic("description")} AS description FROM sources),
m AS (SELECT *, trim(title || ' ' || description) AS hay, list_filter(string_split_regex(topic, '\\s+'), lambda w: length(w) > 2) AS ws, title = topic OR contains(title, topic) OR contains(topic, title) AS exact FROM p),
s AS (SELECT ord, hay, exact, CASE WHEN exact THEN greatest(0.9, len(list_filter(ws, lambda w: contains(hay, w))) / len(ws)) ELSE len(list_filter(ws, lambda w: contains(hay, w))) / len(ws) END AS x FROM m)
SELECT ord, CASE WHEN hay = '' THEN 0.0 ELSE round(x, 6)::DOUBLE END AS score, hay <> '' AND exact AS exactish, CASE WHEN hay = '' THEN 'none' WHEN x >= 0.9 THEN 'strong' WHEN x >= 0.5 THEN 'weak' ELSE 'none' END AS level FROM s""",
)
def place_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.place_evidence(F.lit(_ASK), F.col("title"), F.col("description"))
    return sources(spark, sf_dir).select("ord", e.alias("e")).select("ord", F.round("e.score", 6).alias("score"), "e.exactish", "e.level")


_TAILS = ["around July", "tomorrow", "during summer", "in 2023", "for beginners", "by 3 March 2021 in detail", ""]


@query("query_targets", "SELECT o_orderkey, 'Place ' || o_custkey || ', Karnataka' AS target FROM orders")
def query_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.element_at(F.array(*[F.lit(t) for t in _TAILS]), (F.col("o_orderkey") % len(_TAILS) + 1).cast("int"))
    asked = F.concat(F.lit(' "Place '), F.col("o_custkey"), F.lit(", Karnataka "), tail, F.lit("?"))
    return table(spark, sf_dir, "orders").select("o_orderkey", D.query_target(asked).alias("target"))


@query(
    "source_lists",
    r"""WITH p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS url, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\.', '') AS host FROM pages)
SELECT page_id, 'Answer ' || page_id || '.' AS answer, CAST(2 AS INT) AS n_sources, 'Title ' || page_id AS title, url, host AS domain FROM p""",
)
def source_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, u = F.col("page_id"), F.regexp_replace("url", "#.*$", "")
    said = F.concat(F.lit("Answer "), n, F.lit(".\n\nSources:\n1. [Title "), n, F.lit("]("), u, F.lit(")\n- plain words"))
    out = table(spark, sf_dir, "pages").select("page_id", D.split_sources(said).alias("s"))
    first = F.col("s.sources")[0]
    return out.select("page_id", "s.answer", F.size("s.sources").alias("n_sources"), first["title"].alias("title"), first["url"].alias("url"), first["domain"].alias("domain"))


@query("spoken_science", "SELECT o_orderkey, 'H 2 O yields C ' || (o_orderkey % 90 + 10) || ' at ' || (o_orderkey % 9 + 1) || '.5 times 10 to the -3 kilograms' AS spoken FROM orders")
def spoken_science(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.concat(F.lit("H2O -> C-"), k % 90 + 10, F.lit(" at "), k % 9 + 1, F.lit(".5e-03 kg"))
    return table(spark, sf_dir, "orders").select("o_orderkey", D.speak_science(text).alias("spoken"))


@query(
    "budget_questions",
    "SELECT o_orderkey, floor(o_totalprice)::DOUBLE AS amount, CASE o_orderkey % 3 WHEN 0 THEN 'INR' WHEN 1 THEN 'EUR' ELSE 'USD' END AS currency, CAST(o_orderkey % 20 + 1 AS INT) AS days, 'Goa' AS destination FROM orders",
)
def budget_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, amount = F.col("o_orderkey"), F.floor("o_totalprice").cast("string")
    said = F.when(k % 3 == 0, F.concat(F.lit("within INR "), amount)).when(k % 3 == 1, F.concat(F.lit("about "), amount, F.lit(" eur"))).otherwise(F.concat(F.lit("for $"), amount))
    asked = F.concat(F.lit("trip to Goa for "), k % 20 + 1, F.lit(" days "), said)
    return table(spark, sf_dir, "orders").select("o_orderkey", D.budget(asked).alias("b")).select("o_orderkey", "b.*")


@query("conversation_threads")
def conversation_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequential per conversation, so tested by scenarios instead of SQL."""
    return threads.resolve(turns(spark, sf_dir))
