"""Ordered rule lists as CASE expressions, and evidence predicates.

Patterns stay in the common subset of Java's and RE2's syntax, so the same text serves both engines.
The first rule that fits wins; the order is the meaning.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dates, urls
from .text import COMMON_TERMS, collapse, group, has, intent_tokens, let, query_terms, s, trim, without

# --- fixed values: routing patterns --------------------------------------------------------------------

SQL_TOPIC = r"(?i)\b(?:sql|database|postgres|mysql|sqlite|bigquery|snowflake)\b"
SQL_VERB = r"(?i)\b(?:find|list|show|select|fetch|get|generate|write)\b.*\b(?:all|top|customers|orders|users|products|rows|items|sales|revenue|table|schema|records)\b"
SQL_CLAUSE = r"(?i)\b(?:where|over|greater|less|group by|order by|joined|total|sum|count|amount|days|date|status|showing|having)\b"
EXPLICIT_SEARCH = r"(?i)\b(?:search(?:\s+the\s+web)?|web\s+search|look\s+up|find)\b.+"
NO_FREE_SOURCE = [
    r"(?i)\b(available now|in stock)\b",
    r"(?i)\b(hotels?|pharmacy|gas station|store)\b.*\b(near me|open now|best|reviews?|rating)\b",
    r"(?i)\b(stock|share price|ticker|market price|quote)\b.*\b(now|today|live|current|exact)\b",
]
CATEGORIES = [
    ("weather", "live_required", r"(?i)\b(weather|temperature|forecast|rain|snow|storm|humidity|wind|uv index)\b"),
    ("crypto", "live_required", r"(?i)\b(crypto|bitcoin|btc|ethereum|eth|solana|dogecoin)\b.*\b(price|now|today|live|current|rate)\b|\b(price|rate|quote)\b.*\b(bitcoin|btc|ethereum|eth|crypto)\b"),
    ("sports", "live_required", r"(?i)\b(live scores?|score now|match score|game score|fixtures?|standings|sports news|ipl|nba|nfl|epl|premier league|cricket|football|soccer|tennis)\b"),
    ("disasters", "live_required", r"(?i)\b(earthquake|wildfire|flood|cyclone|hurricane|typhoon|tsunami|volcano|landslide|natural disaster|calamity|emergency alert)\b"),
    ("government", "live_required", r"(?i)\b(government|govt|ministry|minister|president|prime minister|chief minister|governor|mayor|election|parliament|assembly|official announcement|public advisory)\b"),
    ("tourism_food_places", "live_required", r"(?i)\b(tourism|tourist|travel|places to visit|attractions?|temple|museum|hotel|where am i|where i am)\b"),
    ("news", "cached_latest", r"(?i)\b(latest|recent|new|newest|today'?s|this week|current|breaking)\b.*\b(news|announcement|announcements|release|releases|changelog|updates?|papers?|blog posts?)\b|\b(news|announcements|releases|changelog|updates?|papers?|blog posts?)\b.*\b(latest|recent|new|newest|today'?s|this week|current|breaking)\b"),
]
STABLE = [
    r"(?i)\b(explain|what is|define|definition|meaning of|how does|why does)\b",
    r"(?i)\b(code|coding|debug|debugging|bug|error|stack trace|function|api|typescript|javascript|python)\b",
    r"(?i)\b(math|solve|calculate|equation|proof|grammar|rewrite|summarize)\b",
    r"(?i)\b(science concept|physics|chemistry|biology|history|music theory|chords?|guitar strings?)\b",
    r"(?i)\b(story|poem|creative writing|draft|write a)\b",
]
TOPIC_SIGNAL = r"(?i)\b(?:reviews?|hands-on|worth\s+it|vs|compare|comparison|price|available|availability|launched)\b"
DATE_SIGNAL = (
    rf"(?i)\b(?:in|during|as of|on|by|before|after|between|from)\s+(?:\d{{4}}|{dates.MONTH}\s+\d{{1,2}},?\s+\d{{4}}|\d{{1,2}}\s+{dates.MONTH}\s+\d{{4}})\b"
)
ASKS = r"(?i)\b(?:who|what|which|when)\b"
CHANGING = r"(?i)\b(?:won|winner|champion|champions|rank(?:ing|ings)?|standing|standings|captain|coach|ceo|chair(?:person|man)?|president|prime minister|chief minister|mayor|governor|latest|newest|last|movie|film|song|album|release|released|launched|price|value)\b"
DATED_LEAD = r"(?i)\b(?:as of|during|before|after|between|from)\b"
DATED_THING = r"(?i)\b(?:holder|leader|head|winner|champion|ranking|release|price|ceo|captain|coach)\b"


def _in_turn(x: Column, pattern: str) -> Column:
    """``has`` for alternatives ``A.*B`` over a text of one line, in time that follows its length: the first A is settled before a B is looked for, instead of one look per A."""
    sides = re.split(r"\|(?![^(]*\))", pattern.removeprefix("(?i)"))
    return reduce(or_, [has(x, "(?i)^(?>.*?" + a + ").*" + b) if b else has(x, "(?i)" + a) for a, _, b in (side.partition(".*") for side in sides)])


def route(x: Column) -> Column:
    """struct(route, category, confidence) of a message, read to its end."""
    return let({"t": collapse(x)}, lambda m: _route(m["t"]))


def _route(t: Column) -> Column:
    def to(r: str, c: str, p: Column | float) -> Column:
        return F.struct(F.lit(r).alias("route"), F.lit(c).alias("category"), (F.lit(p) if isinstance(p, float) else p).cast("double").alias("confidence"))

    dated = has(t, DATE_SIGNAL) & ((has(t, ASKS) & has(t, CHANGING)) | (has(t, DATED_LEAD) & has(t, DATED_THING)))
    hits = sum((has(t, p).cast("int") for p in STABLE), F.lit(0))
    stable = F.round(F.least(F.lit(0.9), F.greatest(F.lit(0.42), F.least(F.lit(1.0), hits * F.lit(0.28)))), 2)
    out = F.when(t == "", to("clarify", "clarify", 0.2)).when(has(t, SQL_TOPIC) | (_in_turn(t, SQL_VERB) & has(t, SQL_CLAUSE)), to("llm", "sql_generation", 0.99))
    out = out.when(has(t, EXPLICIT_SEARCH), to("live_required", "web_search", 0.88))
    for p in NO_FREE_SOURCE:
        out = out.when(_in_turn(t, p), to("live_required", "unsupported_free_live", 0.82))
    for category, r, p in CATEGORIES:
        out = out.when(_in_turn(t, p), to(r, category, 0.86))
    out = out.when(has(t, TOPIC_SIGNAL) & (F.size(intent_tokens(t)) >= 2), to("live_required", "web_search", 0.82))
    out = out.when(dated, to("live_required", "web_search", 0.84))
    return out.otherwise(to("llm", "stable_knowledge", stable))


# --- fixed values: intent patterns ------------------------------------------------------------------------

FIND_ONLINE = r"(?i)\b(?:search\s+(?:for|the\s+web\s+for|google\s+for)|find\s+(?:articles|news|web\s+pages)\s+about|look\s+up\s+online)\b"
WEATHER = r"(?i)\b(?:weather|forecast|temperature|humidity|rain|rainfall|precipitation|sunny|cloudy|wind\s+speed)\b"
FINANCE = r"(?i)\b(?:price\s+of\s+(?:bitcoin|btc|ethereum|eth|solana|crypto|gold|silver|crude\s+oil)|stock\s+price\s+of|market\s+cap\s+of)\b"
CAPITAL = r"(?i)\b(?:capital\s+of|what\s+is\s+the\s+capital\s+of)\b"
FRESH = r"(?i)\b(?:current|latest|today|now|new)\b"
LEADER = [
    r"(?i)\b(?:current|latest|present|today|now)\s+(?:governor|pm|cm|president|chancellor|minister|mayor|ceo|chairman|leader|ruler|monarch|head\s+of\s+state|pope|director)\b",
    r"(?i)\b(?:who\s+is\s+(?:the\s+)?(?:current|present|latest)?\s*(?:chief\s+minister|prime\s+minister|president|governor|mayor|chancellor|ceo|chairman))\b",
    r"(?i)\b(?:who\s+is\s+(?:the\s+)?(?:cm|pm)\s+of)\b",
]
CODING = [
    r"\b(?:function|def|class|const|let|var|import|export|return|async|await|console\.log|print\(|public\s+static|void\s+main)\b",
    r"(?i)\b(?:javascript|python|typescript|java|c\+\+|c#|golang|rust|php|ruby|swift|kotlin|html|css|sql|dockerfile|yaml|json|regex)\b",
    r"(?i)\b(?:write|create|debug|fix|refactor|optimize|implement|explain)\s+(?:a\s+)?(?:code|function|script|algorithm|regex|query|component|loop|array|endpoint)\b",
    r"(?i)\b(?:how\s+to\s+sort|binary\s+search|linked\s+list|dynamic\s+programming|tree\s+traversal|recursion|memoization|merge\s+sort|quick\s+sort)\b",
]
MATHS = [
    r"(?i)\b(?:calculate|compute|solve|integrate|differentiate|derivative|integral|equation|formula|pythagorean|factorial|matrix|determinant|eigenvalue)\b",
    r"^\s*[\d\s+\-*/^().=xXyYzZ]+\s*$",
]
CREATIVE = [
    r"(?i)\b(?:write\s+(?:a\s+)?(?:story|poem|essay|email|letter|song|joke|haiku|dialogue|script))\b",
    r"(?i)\b(?:explain\s+(?:quantum\s+physics|relativity|gravity|photosynthesis|evolution|mitosis|black\s+hole|machine\s+learning|transformer\s+architecture|how\s+airplanes\s+fly))\b",
    r"(?i)\b(?:what\s+is\s+(?:the\s+difference\s+between|oop|functional\s+programming|recursion|concurrency|multithreading|asynchronous))\b",
]
ROLE_PATTERNS = [
    ("Chief Minister", r"\b(?:cm|chief minister)"),
    ("Prime Minister", r"\b(?:pm|prime minister)"),
    ("President", r"\b(?:president)"),
    ("Governor", r"\b(?:governor)"),
    ("Mayor", r"\b(?:mayor)"),
    ("CEO", r"\b(?:ceo|chief executive officer)"),
    ("Chairperson", r"\b(?:chairman|chairperson)"),
]
ROLE_LEAD = rf"\b(?:{'|'.join(p[5:-1] for _, p in ROLE_PATTERNS)})"
ROLE_TAIL = r"\s+(?:of\s+)?([a-z\s]+?)(?:\?|\.|\n|$|,)"
ROLE_NAMED = r"\s(?:cm|pm|chief minister|prime minister|president|governor|mayor)\b"
ROLE_REVERSED = r"\b(?:who is|what is|tell me|who's)?\s*(?:the\s+)?([a-z\s]+?)\s+(cm|pm|chief minister|prime minister|president|governor|mayor)\b"


def entity_target(x: Column) -> Column:
    """struct(role, jurisdiction): an office and its place; null where none is named."""
    return let({"t": F.lower(s(x))}, lambda r: _entity_target(r["t"]))


def _entity_target(t: Column) -> Column:
    def placed(role: Column, place: Column) -> Column:
        return F.when(F.length(place).between(2, 40), F.struct(role.alias("role"), F.initcap(place).alias("jurisdiction")))

    def reversed_(r: Column) -> Column:
        raw = r["raw"]
        role = F.when(raw == "cm", "Chief Minister").when(raw == "pm", "Prime Minister").otherwise(F.initcap(raw))
        return F.when(raw != "", placed(role, r["place"]))

    found = []
    for role, lead in ROLE_PATTERNS:
        place = F.trim(without(F.trim(group(t, lead + ROLE_TAIL, 1)), r"\b(?:the|current|latest|now|today|is|who)\b", ""))
        found.append(let({"role": F.lit(role), "place": place}, lambda r: placed(r["role"], r["place"])))
    # the pattern tries every start of a long run of words; a text without an office has no match
    parts = {"raw": F.trim(group(t, ROLE_REVERSED, 2)), "place": F.trim(without(group(t, ROLE_REVERSED, 1), r"\b(?:current|the|who is|what is|who's|tell me)\b", ""))}
    found.append(F.when(has(t, ROLE_NAMED), let(parts, reversed_)))
    return F.when(has(t, ROLE_LEAD), F.coalesce(*found))


def intent(x: Column) -> Column:
    """struct(type, category, live) of a query."""
    return let({"t": trim(x)}, lambda r: _intent(r["t"]))


def _intent(t: Column) -> Column:
    def to(kind: str, category: str, live: bool) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.lit(category).alias("category"), F.lit(live).alias("live"))

    any_of = lambda ps: F.coalesce(*[F.when(has(t, p), F.lit(True)) for p in ps], F.lit(False))
    return (
        F.when(t == "", to("static_reasoning", "empty_query", False))
        .when(has(t, FIND_ONLINE), to("explicit_search", "web_search", True))
        .when(has(t, WEATHER), to("domain_specific", "weather", True))
        .when(has(t, FINANCE), to("domain_specific", "finance_crypto", True))
        .when(has(t, CAPITAL) & ~has(t, FRESH), to("static_reasoning", "stable_geographic_fact", False))
        .when(entity_target(t).isNotNull(), to("temporal_fact", "political_leadership", True))
        .when(any_of(LEADER), to("temporal_fact", "civic_or_leadership_fact", True))
        .when(any_of(CODING), to("static_reasoning", "coding", False))
        .when(any_of(MATHS), to("static_reasoning", "mathematics", False))
        .when(any_of(CREATIVE), to("static_reasoning", "conceptual_or_creative", False))
        .otherwise(to("static_reasoning", "general_reasoning", False))
    )


# --- fixed values: quality-risk patterns -----------------------------------------------------------------------

RISK_BOTH = [
    ("challenged_or_uncertain", r"\b(wrong|incorrect|hallucinat|made that up|not true|check again|recheck|verify|are you sure)\b"),
    ("high_stakes", r"\b(medical|medicine|symptom|diagnos|dose|legal|lawyer|contract|financial|investment|tax|self-harm|suicide|emergency)\b"),
    ("code", r"```|\b(code|function|script|program|debug|algorithm|sql|javascript|python)\b"),
    ("calculation", r"\b(calculate|equation|formula|percent|probability|equals?)\b|(?:\d+\s*[-+*/]\s*\d+)"),
]
RISK_UNSURE = r"\b(i'?m not sure|not sure|cannot verify|can't verify|could not verify|unable to verify|not enough information|may be|might be|likely|possibly|probably|unclear|unknown|not certain|uncertain)\b"
RISK_CLAIM = r"\b(according to|sources say|source says|reported by|confirmed by|evidence shows|research shows|study found|verified by|cited by)\b"
RISK_LINK = r"(?i)(https?://|\[[^\]]+\]\(https?://)"
RISK_NOW = r"(?i)\b(current|today|now|presently|incumbent|latest|live|as of today|as of now|this year|this month)\b"
RISK_STATE = r"\b(is|are|was|were|has|have|serves|served|released|launched|won|announced|appointed|elected)\b"
RISK_DATED = r"\b(?:on|as of|in|during)\s+(?:\d{1,2}\s+[A-Z][a-z]+|[A-Z][a-z]+\s+\d{1,2}|(?:19|20)\d{2})\b"
RISK_NAME = r"\b[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){0,4}\b"


RISK_NAMES = r"\b[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){1,4}\b"
RISK_DEED = r"\b(is|are|was|were|became|serves|served|founded|created|invented|discovered|won|released|launched|announced|appointed|elected)\b"
RISK_SOURCED = r"(?i)(https?://|\[[^\]]+\]\(https?://|Sources:\s*)"
RISK_ROUTE = r"\b(fallback|service_unavailable|service_error|unknown_general_knowledge_answer|crawl4ai_unavailable|low_confidence)\b"


def risk_flags(message: Column, answer: Column, purpose: Column | None = None, note: Column | None = None, mutable: Column | None = None) -> Column:
    """Distinct reasons to review an answer, at most five, in order.

    ``purpose`` is what the answer is for, ``note`` why it came by its route, ``mutable`` whether the message asks for a fact that may change.
    """
    m, a = s(message), s(answer)
    parts = {"m": m, "a": a, "both": F.lower(F.concat(m, F.lit("\n"), a)), "low": F.lower(a)}
    more = {"purpose": purpose, "note": note, "mutable": mutable}
    return let(parts | {k: c for k, c in more.items() if c is not None}, lambda r: _risk_flags(r, *[r[k] if c is not None else None for k, c in more.items()]))


def _risk_flags(r: Column, purpose: Column | None, note: Column | None, mutable: Column | None) -> Column:
    m, a, both, low = r["m"], r["a"], r["both"], r["low"]
    both_of = dict(RISK_BOTH)
    flags = [
        F.when(s(purpose).isin("verify_answer", "selection_verify"), "explicit_verification") if purpose is not None else None,
        F.when(has(both, both_of["challenged_or_uncertain"]), "challenged_or_uncertain"),
        F.when(has(low, RISK_UNSURE), "model_uncertainty"),
        F.when(has(low, RISK_CLAIM) & ~has(a, RISK_LINK), "source_like_claim_without_source"),
        F.when(has(m, RISK_NOW) & has(low, RISK_STATE), "current_or_date_sensitive_claim"),
        F.when(has(m, RISK_DATED) & has(a, RISK_NAME), "dated_named_entity_claim"),
        F.when(mutable & has(a, RISK_NAMES) & has(low, RISK_DEED) & ~has(a, RISK_SOURCED), "unsupported_named_entity_claim") if mutable is not None else None,
        F.when(has(F.lower(s(note)), RISK_ROUTE), "routing_uncertainty") if note is not None else None,
        *[F.when(has(both, both_of[k]), k) for k in ("high_stakes", "code", "calculation")],
    ]
    return F.slice(F.array_compact(F.array(*[f for f in flags if f is not None])), 1, 5)


# --- evidence predicates ------------------------------------------------------------------------------------------

LOOKUP_ONLY = ("reference_lookup", "archive_lookup", "community_discussion")
SEARCH_PAGE = r"search:|webcache|cache\.google|/search(?:[/?#]|$)|[?&]q="
ARCHIVE = r"(?i)archive\.(today|ph|is)|webcache"
LISTED_TYPES = r"^(encyclopedia|structured_reference|trusted_news|public_news|cached_latest|free_|exa_)"
STRONG_DOMAIN = r"(?i)(?:\.gov$|\.gov\.|\.go\.|gov\.|wikipedia\.org$|wikidata\.org$|bbc\.com$|reuters\.com$|apnews\.com$|thehindu\.com$)"
DISCOVERY = r"\b(discover|discovered|discovery|invent|invented|invention|founder|founded|created|creator)\b"
FORMER = r"\b(no longer|former|replaced by|successor|stepped down|resigned)\b"
PRESENT = r"\b(current|incumbent|serving|serves as|present)\b"


def discovery_subject(query: Column) -> Column:
    """What a who-discovered question is about; null for other questions."""
    t = collapse(without(F.lower(s(query)), r"[?.!]+$", ""))
    hit = F.coalesce(
        *[
            F.nullif(group(t, p, 1), F.lit(""))
            for p in (
                r"^(?:who\s+)?(?:discovered|invented|founded|created)\s+(.+)$",
                r"^(?:who\s+was\s+)?(?:the\s+)?(?:discoverer|inventor|founder|creator)\s+of\s+(.+)$",
                r"^(.+?)\s+(?:discoverer|inventor|founder|creator)$",
            )
        ]
    )
    subject = collapse(without(hit, r"\b(?:the|a|an)\b", " "))
    return F.when(hit.isNotNull() & F.length(subject).between(1, 90), subject)


def own_terms(x: Column) -> Column:
    common = F.array(*[F.lit(t) for t in COMMON_TERMS])
    return F.filter(query_terms(x), lambda t: ~F.array_contains(common, t))


def is_discovery_source(subject: Column, title: Column, description: Column) -> Column:
    hay = F.lower(F.concat_ws(" ", s(title), s(description)))
    words = own_terms(subject)
    return (F.size(words) > 0) & F.forall(words, lambda t: F.contains(hay, t)) & (has(hay, DISCOVERY) | F.contains(F.lower(s(title)), F.lower(subject)))


def is_related(query: Column, hay: Column, subject: Column | None = None) -> Column:
    """Two thirds of the subject's own terms (or the query's), two at least, occur; a lone term needs four letters; a subject of two words or more is enough as a phrase."""
    subject = F.coalesce(F.nullif(s(subject), F.lit("")), query) if subject is not None else query
    text = F.trim(F.regexp_replace(F.lower(s(hay)), r"[^a-z0-9]+", " "))
    phrase = F.trim(F.regexp_replace(F.lower(s(subject)), r"[^a-z0-9]+", " "))
    long = lambda x: F.filter(own_terms(x), lambda t: (F.length(t) > 2) | t.rlike(r"^\d{4}$"))
    words = F.when(F.size(long(subject)) > 0, long(subject)).otherwise(long(query))
    n = F.size(words)
    hits = F.size(F.filter(words, lambda t: F.contains(text, t)))
    need = F.least(n, F.greatest(F.lit(2), F.ceil(n * F.lit(0.67)).cast("int")))
    by_terms = F.when(n == 0, False).when(n == 1, (F.length(words[0]) >= 4) & (hits == 1)).otherwise(hits >= need)
    return (text != "") & ((phrase.rlike(r"\s") & F.contains(text, phrase)) | by_terms)


def is_related_topic(query: Column, hay: Column, subject: Column) -> Column:
    """For a current topic: the subject as a phrase, or two thirds of its terms and as many of the query's."""
    kept = lambda x: F.filter(own_terms(x), lambda t: ~t.rlike(r"^\d$"))
    low = F.lower(s(hay))
    phrase = F.trim(F.regexp_replace(F.lower(s(subject)), r"[^a-z0-9]+", " "))
    n = F.size(kept(subject))
    of_subject, of_query = (F.size(F.filter(kept(x), lambda t: F.contains(low, t))) for x in (subject, query))
    need = F.least(n, F.greatest(F.lit(2), F.ceil(n * F.lit(0.67)).cast("int")))
    by_terms = F.when(n <= 1, (of_subject == n) & (of_query >= 2)).otherwise((of_subject >= need) & (of_query >= need))
    return ((s(subject) != "") & F.contains(F.regexp_replace(low, r"[^a-z0-9]+", " "), phrase)) | by_terms


def is_citation(query: Column, title: Column, url: Column, description: Column, kind: Column, domain: Column, fetched: Column, level: Column, shortcut: Column | None = None, related: Column | None = None) -> Column:
    """May a source be cited for a query. ``related`` (see ``queries.related``) says whether it is about it; without it, the generic rule does."""
    t, u, d, k = trim(title), trim(url), trim(description), trim(kind)
    dom = F.lower(F.when(s(domain) == "", urls.host(u)).otherwise(s(domain)))
    seen = F.lower(F.concat_ws(" ", t, d, u))
    subject = discovery_subject(query)
    own = F.size(own_terms(query))
    related = related if related is not None else (
        F.when(subject.isNotNull(), is_discovery_source(subject, t, d)).when(has(k, "(?i)^free_"), True).when(own == 0, True).otherwise(is_related(query, F.concat_ws(" ", t, d)))
    )
    fetched = F.coalesce(fetched, F.lit(False))
    shortcut = F.lit(False) if shortcut is None else F.coalesce(shortcut, F.lit(False))
    return (
        F.when((t == "") | (u == "") | (k == "") | k.isin(*LOOKUP_ONLY) | (F.length(d) < 20), False)
        .when(has(seen, SEARCH_PAGE) | has(dom, ARCHIVE), False)
        .when((k == "official_source") & ~fetched, False)
        .when(s(level) == "structured_claim", True)
        .when(k == "official_source", shortcut | related)
        .when(has(k, LISTED_TYPES), related)
        .otherwise(False)
    )


def is_strong(kind: Column, domain: Column, fetched: Column, level: Column, trusted: Column) -> Column:
    d = F.lower(s(domain))
    return (
        (s(level) == "structured_claim")
        | ((s(kind) == "official_source") & F.coalesce(fetched, F.lit(False)))
        | (F.coalesce(trusted, F.lit(False)) & ~has(d, r"(?i)reddit|archive\.(today|ph|is)"))
        | has(d, STRONG_DOMAIN)
    )


# --- fixed values: failures, payloads -------------------------------------------------------------------------------

ABUSE_PHRASE = r"(?i)(?:\b(?:ignore|forget)\s+(?:all|previous)\s+instructions\b|\bact as\b|\bsystem prompt\b)"
ABUSE_MARKUP = r"(?i)(?:<script|javascript:|onerror=|onload=)"
CACHE_BYPASS = r"(?i)\b(today|tomorrow|yesterday|now|current|live|time|date|stock|price|weather|random|dice|coin)\b"


def is_abusive(x: Column) -> Column:
    t = s(x)
    return (F.length(t) > 500_000) | (has(t, ABUSE_PHRASE) & (F.length(t) > 12_000)) | has(t, ABUSE_MARKUP)


def bypasses_cache(x: Column) -> Column:
    return s(x).rlike(CACHE_BYPASS)


def missing_fields(required: list[str], row: dict[str, Column]) -> Column:
    """Names of required fields that are null or blank."""
    return F.array_compact(F.array(*[F.when(trim(row[f]) == "", F.lit(f)) if f in row else F.lit(f) for f in required]))
