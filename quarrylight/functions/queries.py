"""Questions rewritten: subject, intent, freshness, expansions, offices and their holders, small normalisers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dates, urls
from .dialogue import query_target
from .rules import CHANGING, discovery_subject, is_discovery_source, is_related, is_related_topic, own_terms
from .text import collapse, group, has, let, s, search_query, topic_terms, trim, without

# --- fixed values: patterns ----------------------------------------------------------------------------------

ASK_TO_SEARCH = r"(?i)^(?:please\s+)?(?:can\s+you\s+|could\s+you\s+)?(?:search(?:\s+the\s+web)?(?:\s+for)?|web\s+search(?:\s+for)?|look\s+up|find(?:\s+me)?|google)\s+(.+)$"
OFFICE_OF = r"(?i)\b(?:ceo|cfo|cto|chair(?:person|man)?|president|prime minister|chief minister|mayor|governor|captain|coach)\s+(?:of|for|at|in)\s+(.+)$"
TOPIC_WORDS = r"(?i)\b(?:latest|recent|current|newest|reviews?|review|hands-on|worth\s+it|good|best|price|available|availability|launched|released?|winner|won|champion|rankings?|standings?|compare|comparison|vs|movies?|films?|songs?|albums?|releases?)\b"
YEAR_PHRASE = r"(?i)\b(?:in|during|as of|by|before|after)\s+\d{4}\b"
SMALL_WORDS = r"(?i)\b(?:of|for|about|on|the|is|are|should|i|buy|get|now|today|live|exact|rate)\b"
FRESH_OR_REVIEW = r"\b(reviews?|hands-on|worth\s+it|vs|compare|comparison|price|available|availability|launched)\b"
FRESH_WORD = r"(?i)\b(?:latest|recent|current|newest|today|now|breaking)\b"
ROLES = [
    ("ceo", r"\bceo\b|\bchief\s+executive\s+officer\b", "P169"),
    ("prime minister", r"\bprime\s+minister\b|\bpm\b", "P6"),
    ("chief minister", r"\bchief\s+minister\b|\bcm\b", "P39"),
    ("first minister", r"\bfirst\s+minister\b", "P39"),
    ("president", r"\bpresident\b", "P35"),
    ("governor", r"\bgovernor\b", "P39"),
    ("premier", r"\bpremier\b", "P39"),
    ("mayor", r"\bmayor\b", "P39"),
    ("head of government", r"\bhead\s+of\s+government\b", "P6"),
    ("head of state", r"\bhead\s+of\s+state\b", "P35"),
]
PLACE_LEAD = r"(?i)^\s*(?:who|what)\s+(?:is|was|are|were)\s+(?:the\s+)?"
PLACE_TAIL = r"(?i)\b(?:current|latest|present|incumbent|official|government|leader|office|holder|name|country|state|province)\b$"
STALE = r"(?i)\b(?:former|previous|ex-|served\s+until|was\s+the|had\s+been|from\s+\d{4}\s+(?:to|through|-)\s+\d{4}|history|list\s+of|election)\b"
PERSON = r"([A-Z][A-Za-z.'’-]+(?:\s+[A-Z][A-Za-z.'’-]+){0,5})"
NOT_A_NAME = r"(?i)\b(?:chief|minister|president|governor|mayor|office|government|current|former|served)\b"


def subject(x: Column) -> Column:
    """What a search is about: the place of an office, else the words that are neither fresh nor small."""

    def build(r: Column) -> Column:
        rest = collapse(without(without(without(r["q"], TOPIC_WORDS, " "), YEAR_PHRASE, " "), SMALL_WORDS, " "))
        rest = F.trim(F.regexp_replace(F.regexp_replace(rest, r"\s*\(\s*", " "), r"\s*\)\s*", ""))
        return query_target(F.when(r["office"] != "", r["office"]).otherwise(rest))

    return let({"q": search_query(x)}, lambda r: let({"q": r["q"], "office": group(r["q"], OFFICE_OF)}, build))


def intent_term(x: Column) -> Column:
    """latest, comparison, review or reviews. Only the outer words of each list are bound to word borders."""
    return let({"t": F.lower(s(x))}, lambda r: _intent_term(r["t"]))


def _intent_term(t: Column) -> Column:
    return F.when(has(t, r"\bprice|available|availability|launched|released?\b"), "latest").when(has(t, r"\bvs|compare|comparison\b"), "comparison").when(has(t, r"\bworth\s+it|best\b"), "review").otherwise("reviews")


def is_dated_fact(x: Column) -> Column:
    t = F.lower(s(x))
    return has(t, CHANGING) & dates.date_window(t).isNotNull()


def _two_words(subject: Column) -> Column:
    """A subject is trimmed, so white space within it parts two words."""
    return has(subject, r"\S\s+\S")


def is_current_topic(x: Column, about: Column | None = None) -> Column:
    """``about`` is the subject of ``x``, for callers that have it."""
    return (has(F.lower(s(x)), FRESH_OR_REVIEW) | is_dated_fact(x)) & _two_words(subject(x) if about is None else about)


def rewrite(x: Column) -> Column:
    """struct(query, subject, intent, fresh): a search request without its command words."""
    def raw(r: Column) -> Column:
        asked = F.when(r["told"] != "", r["told"]).otherwise(r["q"])
        return search_query(F.regexp_replace(F.regexp_replace(asked, r"(?i)^(?:about|on|for)\s+", ""), r"[?.!]+$", ""))

    def build(r: Column) -> Column:
        t = r["target"]
        # a dated fact is fresh whatever its subject, so only review words ask for two words of subject
        fresh = lambda about: has(t, FRESH_WORD) | (has(F.lower(t), FRESH_OR_REVIEW) & _two_words(about)) | is_dated_fact(t)
        told = lambda about: F.struct(r["raw"].alias("query"), about.alias("subject"), intent_term(t).alias("intent"), fresh(about).alias("fresh"))
        return let({"about": subject(t)}, lambda a: told(a["about"]))

    empty = F.struct(F.lit("").alias("query"), F.lit("").alias("subject"), F.lit("general").alias("intent"), F.lit(False).alias("fresh"))
    of_raw = lambda raw: let({"raw": raw}, lambda r: let({"raw": r["raw"], "target": query_target(r["raw"])}, build))
    of_query = lambda r: F.when(r["q"] == "", empty).otherwise(let({"q": r["q"], "told": group(r["q"], ASK_TO_SEARCH)}, lambda r: of_raw(raw(r))))
    return let({"q": F.trim(F.regexp_replace(search_query(x), r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", ""))}, of_query)


def related(query: Column, title: Column, description: Column, label: Column, kind: Column, date: Column) -> Column:
    """Is a source about a query: by the discovery it asks for, its type, its topic, its news, or its words."""
    hay = F.lower(F.concat_ws(" ", s(title), s(description), s(label)))
    found, about = discovery_subject(query), subject(query)
    own = own_terms(query)
    return (
        F.when(found.isNotNull(), is_discovery_source(found, title, description))
        .when(has(s(kind), "(?i)^free_") | (F.size(own) == 0), True)
        .when(is_current_topic(query), is_related_topic(query, hay, about))
        .when(has(s(kind), "(?i)^(trusted_news|public_news)$") & (s(date) != ""), F.exists(own, lambda t: F.contains(hay, t)))
        .otherwise(is_related(query, hay, about))
    )


def review_queries(x: Column) -> Column:
    """Three phrasings for a current topic; none for anything else."""

    def build(r: Column) -> Column:
        forms = F.array(*[search_query(F.concat(r["who"], F.lit(w), r["what"])) for w in (" ", " recent ", " latest ")])
        return F.when(is_current_topic(r["x"], r["who"]) & (r["who"] != ""), F.array_distinct(forms)).otherwise(F.array().cast("array<string>"))

    return let({"x": s(x), "who": subject(x), "what": intent_term(x)}, build)


def phases(x: Column) -> Column:
    """array of arrays: the exact query, up to five broad ones, up to five for official sources."""

    def build(r: Column) -> Column:
        q, who = r["q"], F.when(r["who"] != "", r["who"]).otherwise(r["q"])
        broad = F.slice(F.array_distinct(F.concat(F.array(q), r["reviews"])), 1, 5)
        official = F.array_distinct(F.array(*[search_query(v) for v in (F.concat(q, F.lit(" official source")), F.concat(who, F.lit(" official")), F.concat(q, F.lit(" Wikipedia Wikidata")), F.concat(who, F.lit(" current source")))]))
        return F.when(q == "", F.array().cast("array<array<string>>")).otherwise(F.array(F.array(q), broad, official))

    return let({"q": search_query(x), "who": rewrite(x)["subject"], "reviews": review_queries(x)}, build)


def chat_queries(x: Column, recent: Column | None = None) -> Column:
    """Up to four live queries: as asked, latest, official, and with recent context where the question is short."""
    q = trim(x)
    extra = F.when((F.length(q) < 220) & (s(recent) != ""), F.concat_ws(" ", q, s(recent))) if recent is not None else F.lit(None).cast("string")
    return F.when(q == "", F.array().cast("array<string>")).otherwise(F.slice(F.array_distinct(F.array_compact(F.array(q, F.concat(F.lit("latest "), q), F.concat(q, F.lit(" official update")), extra))), 1, 4))


def jurisdiction(x: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(dates.strip_dates(x), PLACE_LEAD, " "), r"(?i)^\s*(?:the|a|an)\s+", " ")
    t = F.regexp_replace(without(t, PLACE_TAIL, " "), r"^[,:\s]+|[,:\s?!.]+$", "")
    return collapse(F.regexp_replace(t, r"\s*,\s*", " "))


def office(x: Column) -> Column:
    """struct(role, property, jurisdiction) of a question for an office; null where it names no office and place."""
    first = let({"q": search_query(x)}, lambda r: F.coalesce(*_offices(r["q"])))
    return let({"o": first}, lambda r: F.when(F.length(r["o"]["jurisdiction"]) >= 2, r["o"]))


def _offices(q: Column) -> list[Column]:
    """The struct of each known office, null where the question does not name it."""
    found = []
    for role, p, prop in ROLES:
        after = group(q, rf"(?i)(?:{p})\s+(?:of|for|in)\s+(.+?)[?.!]*$")
        before = group(q, rf"(?i)\b(.+?)\s+(?:current\s+|latest\s+)?(?:{p})[?.!]*$")
        place = jurisdiction(F.when(after != "", after).otherwise(before))
        found.append(F.when(has(q, f"(?i){p}"), F.struct(F.lit(role).alias("role"), F.lit(prop).alias("property"), place.alias("jurisdiction"))))
    return found


def holder_name(x: Column) -> Column:
    """A person's name without titles; empty where what is left is none."""
    t = without(s(x), r"(?i)\b(?:the|current|present|incumbent|hon'?ble|honorable|shri|smt|mr|ms|dr)\b\.?", " ")
    t = collapse(F.regexp_replace(t, r"[,;:].*$", " "))
    return let({"t": t}, lambda r: F.when((F.length(r["t"]) < 3) | (F.length(r["t"]) > 90) | has(r["t"], NOT_A_NAME), "").otherwise(r["t"]))


def holder(text: Column, role: str, place: str) -> Column:
    """The current holder an official text names, from its first 80 sentences; null where none does."""
    import re

    who, where = re.escape(role), re.escape(place)
    clean = F.regexp_replace(collapse(text), r"\s+([,.;:!?])", "$1")
    sentences = F.slice(F.regexp_extract_all(clean, F.lit(r"([^.!?]+[.!?]?)"), 1), 1, 80)
    good = F.filter(F.transform(sentences, lambda v: F.trim(v)), lambda v: (v != "") & ~has(v, STALE) & v.rlike(f"(?i){who}") & v.rlike(f"(?i){where}|current|present|incumbent|official"))
    patterns = [
        rf"\b(?:[Cc]urrent\s+|[Pp]resent\s+|[Ii]ncumbent\s+)?(?i:{who})\s+(?:of|for|in)\s+(?i:{where})\s+(?:is|:|-)\s+{PERSON}",
        rf"\b{PERSON}\s+(?:is|serves\s+as|has\s+been\s+appointed\s+as)\s+(?:the\s+)?(?:current\s+|present\s+|incumbent\s+)?(?i:{who})\s+(?:of|for|in)\s+(?i:{where})",
    ]
    names = F.filter(F.flatten(F.transform(good, lambda v: F.array(*[holder_name(group(v, p)) for p in patterns]))), lambda n: n != "")
    return F.try_element_at(names, F.lit(1))


def portal_confidence(url: Column, from_registry: Column) -> Column:
    d = urls.host(url)
    return F.when(d == "", "low").when(from_registry, "high").when(d.rlike(r"(?i)(\.gov$|\.gov\.[a-z]{2}$|^gov\.|\.go\.[a-z]{2}$|gc\.ca$|europa\.eu$|un\.org$)"), "medium").otherwise("low")


def claim_range(start: Column, end: Column) -> Column:
    a, b = trim(start), trim(end)
    return F.when((a != "") & (b != ""), F.concat(a, F.lit(" to "), b)).when(a != "", F.concat(a, F.lit(" onward"))).when(b != "", F.concat(F.lit("until "), b)).otherwise("")


def contextual(query: Column, anchor: Column) -> Column:
    """A follow-up question with its conversation's anchor, where it does not name what it is about."""
    parts = lambda r: {"q": r["q"], "anchor": anchor, "low": F.lower(r["q"]), "words": topic_terms(r["q"]), "about": topic_terms(anchor)}
    return let({"q": trim(query)}, lambda r: let(parts(r), _contextual))


def _contextual(r: Column) -> Column:
    q, low, anchor = r["q"], r["low"], r["anchor"]
    shared = F.size(F.array_intersect(r["words"], r["about"])) > 0
    n = F.size(r["words"])
    named = has(q, r"(?i)^(who|what)\s+(?:is|are|was|were)\s+(?:the\s+)?[A-Z][A-Za-z0-9.'-]+(?:\s+[A-Z][A-Za-z0-9.'-]+){0,5}\??$") | has(q, r"(?i)^(tell me about|explain|define)\s+[A-Z][A-Za-z0-9.'-]+(?:\s+[A-Z][A-Za-z0-9.'-]+){0,5}\??$")
    diverted = has(low, r"\b(now|instead|different topic|another topic|new topic|change topic|switch topic)\b") | ((n >= 4) & has(low, r"\b(who is|what is|tell me about)\s+[a-z0-9][a-z0-9\s-]{2,}"))
    vague = has(low, r"\b(it|its|they|them|that|this|these|those|there|same|above|earlier|previous|first match|opening match|that match|that game|who are playing|who is playing)\b") | ((n > 0) & (n <= 3)) | (has(low, r"^(who|what|when|where|which|how)\b") & (n <= 4))
    return F.when((s(anchor) == "") | shared | named | diverted | ~vague, q).otherwise(collapse(F.concat_ws(" ", q, anchor)))


# What preferences may say.
PREFERENCES = {"response_length": ("short", "normal", "detailed"), "response_format": ("paragraph", "bullet", "steps"), "response_style": ("balanced", "witty", "chatty", "supportive", "debate")}


def preferences(row: dict[str, Column]) -> Column:
    """struct of the known preferences; null where a value is none of the allowed ones."""
    return F.struct(*[F.when(row.get(k, F.lit(None)).isin(*allowed), row.get(k, F.lit(None))).alias(k) for k, allowed in PREFERENCES.items()])


def market_mode(mode: Column, query: Column, exchange: Column, news: Column) -> Column:
    """Which lookup a request is, by its mode or else by the fields it has."""
    m = F.lower(trim(mode))
    return (
        F.when(m == "market", "markets").when(m.isin("news", "exchange", "budget_plan", "markets"), m).when(exchange, "exchange")
        .when(has(s(query), r"(?i)\b(budget|trip|travel|itinerary|under|within|days?)\b"), "budget_plan").when(news, "news").otherwise("markets")
    )


def zone_time(at: Column, zone: str) -> Column:
    """struct(iso, local, year) of a UTC time in a zone."""
    local = F.from_utc_timestamp(at, zone)
    return F.struct(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("iso"), F.date_format(local, "EEEE, MMMM d, yyyy, h:mm:ss a").alias("local"), F.year(at).alias("year"))


