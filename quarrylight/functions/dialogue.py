"""Front-end routes, failure classes, workflows, place evidence, targets of queries, source lines, spoken science.

Rule lists in order, as CASE expressions. Pronouns, places and dates are cut or found by patterns only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls
from .dates import MONTH
from .text import collapse, group, has, let, s, trim, without

# --- fixed values: front-end routes -------------------------------------------------------------------

FILLER = r"\b(?:no|nope|nah|just|generally|actually|i'?m|im|i am|asking|so|well|um|uh|like)\b"
LIVE = r"(?i)\b(latest|current|currently|today|tonight|now|recent|new|news|update|updates|as of|live|real[-\s]?time|open now|near me|nearby|weather|price|stock|crypto|score|sources?|cite|citation|web|search)\b"
PLACE = r"(?i)\b(museum|museums|landmark|landmarks|attraction|attractions|restaurant|restaurants|hotel|hotels|near me|nearby|directions|map|places to visit|tourist|tourism|beach|beaches|hill station|hill stations|waterfall|temple|park|sightseeing|things to do)\b"
SAFETY = r"(?i)\b(medical|medicine|diagnosis|symptom|dose|dosage|drug|treatment|legal|lawyer|contract|court|tax|investment|financial advice|self[-\s]?harm|suicide|weapon|malware)\b"
ROLE = r"(?i)\b(ceo|cfo|cto|president|prime minister|chief minister|governor|mayor|minister|captain|coach|founder|founded|head of|leader)\b"
STABLE = r"(?i)^(?:what\s+is|what'?s|who\s+is|who\s+was|how\s+does|how\s+do|explain|define|tell\s+me\s+about)\s+[\w\s.'-]{2,80}\??$"
CAPABILITY = r"(?i)^(?:do|can|are|will)\s+you\b|^do\s+you\s+understand\s+[A-Za-z][A-Za-z\s-]{1,40}\??$"
SHORT_EXPLAINER = r"(?i)^(?:what\s+does|why\s+do|why\s+does|why\s+is|how\s+to|difference\s+between)\b"
TRANSFORM = r"(?i)^(?:rewrite|rephrase|summarize|summarise|translate|make (?:it|this|that) (?:shorter|simpler|more professional)|explain (?:this|that|it) (?:simply|in simple terms)|turn (?:this|that|it) into (?:bullets|steps))\b"
JOKE = r"(?i)^(?:tell me a joke|make me laugh|say something funny)\b"
GREETING = r"^(?:hi|hello|hey|yo|sup|thanks|thank you|good morning|good afternoon|good evening)$"
HOW_ARE_YOU = r"\b(how are you|how are you doing|how you doing|how is your day|how's your day|what'?s up|are you there|you there)\b"
THANKS = r"^(?:thanks|thank you|thank u|appreciate it)\b"


def is_casual(x: Column) -> Column:
    t = F.trim(F.regexp_replace(without(F.regexp_replace(F.lower(s(x)), r"[^\p{L}\p{N}\s']", " "), FILLER, " "), r"\s+", " "))
    return (t != "") & (has(t, GREETING) | has(t, HOW_ARE_YOU) | has(t, THANKS))


def is_simple(x: Column) -> Column:
    t = trim(x)
    marked = has(t, LIVE) | has(t, SAFETY) | has(t, PLACE) | has(t, ROLE)
    plain = has(t, STABLE) | has(t, CAPABILITY) | (has(t, SHORT_EXPLAINER) & (F.length(t) <= 120))
    return F.length(t).between(1, 160) & (is_casual(t) | (~marked & plain))


def front_route(x: Column) -> Column:
    """struct(route, reason) of a message without any context."""

    def to(route: str, reason: str) -> Column:
        return F.struct(F.lit(route).alias("route"), F.lit(reason).alias("reason"))

    def choose(r: Column) -> Column:
        t = r["t"]
        return (
            F.when(t == "", to("clarify", "empty_message"))
            .when(r["casual"], to("fast_simple", "casual_conversation"))
            .when((F.length(t) <= 120) & has(t, JOKE), to("fast_simple", "joke_request"))
            .when((F.length(t) <= 180) & has(t, TRANSFORM), to("fast_simple", "transform_request"))
            .when(has(t, SAFETY), to("safety_sensitive", "safety_sensitive_query"))
            .when(has(t, PLACE), to("place_grounded", "place_query_requires_evidence"))
            .when(has(t, LIVE), to("live_required", "source_or_freshness_required"))
            .when(is_simple(t), to("fast_simple", "simple_stable_question"))
            .otherwise(to("chat_direct", "default_direct_chat"))
        )

    return let({"t": trim(x), "casual": is_casual(x)}, choose)


# --- fixed values: failures ---------------------------------------------------------------------------------

FAILURES = [
    ("aborted", r"abort"),
    ("network_timeout", r"timeout|timed out|network|failed to fetch|service unavailable|temporar|rate limit|429|5\d\d"),
    ("permission_blocked", r"permission|not-allowed|denied|microphone|camera"),
    ("retrieval_empty", r"no (?:usable )?(?:sources?|results?)|retrieval.?empty|could not find enough"),
    ("model_empty", r"empty answer|model.?empty|no response|blank response"),
]


def failure(message: Column, code: Column | None = None) -> Column:
    """One of six failure codes; a code that is one of them decides before the text of later classes."""
    t, c = F.lower(s(message)), F.lower(s(code)) if code is not None else F.lit("")
    out = F.when(F.lit(False), "")
    for name, p in FAILURES:
        out = out.when((c == name) | has(t, p), name)
    return out.when((c == "transient_failure") | (t == "transient_failure"), "network_timeout").otherwise("unknown")


# What a status of an upstream service means.
STATUS = [((401, 403), "provider_auth_failed"), ((402,), "provider_quota"), ((429,), "rate_limited"), ((400, 404, 422), "provider_bad_request")]


def status_error(status: Column) -> Column:
    out = F.when(status.isNull() | (status < 400), F.lit(None).cast("string"))
    for codes, name in STATUS:
        out = out.when(status.isin(*codes), name)
    return out.otherwise("provider_unavailable")


# --- places ------------------------------------------------------------------------------------------------------

PLACE_STOP = r"\b(?:the|a|an|near|nearby|in|at|of|for|to|visit|places|place|best|top|around|open|now|please|show|find)\b"
PLACE_TYPE = r"(?i)\b(museum|museums|temple|park|beach|fort|palace|landmark|attraction|attractions|restaurant|hotel|hotels)\b"


def place_topic(x: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.lower(s(x)), "<[^>]*>", " "), r"[^a-z0-9\s'-]", " ")
    return F.trim(F.regexp_replace(without(t, PLACE_STOP, " "), r"\s+", " "))


def place_evidence(query: Column, title: Column, description: Column) -> Column:
    """struct(score, exactish, level): how well a result names the place a query asks for."""

    def measure(r: Column) -> Column:
        topic, name, hay = r["topic"], r["title"], F.trim(F.concat_ws(" ", r["title"], r["description"]))
        words = F.filter(F.split(topic, r"\s+"), lambda w: F.length(w) > 2)
        share = F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: F.contains(hay, w))) / F.size(words)).otherwise(0.0)
        exact = (name == topic) | F.contains(name, topic) | F.contains(topic, name)
        score = F.when(exact, F.greatest(F.lit(0.9), share)).otherwise(share)
        level = F.when((score >= 0.9) | ((score >= 0.67) & ~r["typed"]), "strong").when(score >= 0.5, "weak").otherwise("none")
        none = F.struct(F.lit(0.0).alias("score"), F.lit(False).alias("exactish"), F.lit("none").alias("level"))
        return F.when((topic == "") | (hay == ""), none).otherwise(F.struct(score.alias("score"), exact.alias("exactish"), level.alias("level")))

    return let({"topic": place_topic(query), "title": place_topic(title), "description": place_topic(description), "typed": has(s(query), PLACE_TYPE)}, measure)


# --- targets of queries ---------------------------------------------------------------------------------------------

SEASON = "(?:summer|winter|spring|autumn|fall|monsoon|rainy season|dry season)"
RELATIVE = "(?:today|tomorrow|tonight|now|right now|currently|this morning|this afternoon|this evening|this week|this month|this year|next week|next month|next year)"
TAILS = [
    rf"(?:around|about|in|during|for|on|as of|by|before|after|from)\s+(?:the\s+)?(?:month\s+of\s+)?{MONTH}(?:\s+\d{{1,2}}(?:st|nd|rd|th)?)?(?:,?\s+(?:19|20)\d{{2}})?",
    rf"(?:around|about|in|during|for)\s+{SEASON}",
    r"(?:in|during|for|as of|by|before|after|from)\s+(?:19|20)\d{2}",
    r"(?:on|as of|by)\s+\d{1,2}(?:st|nd|rd|th)?\s+[A-Za-z]+\s*,?\s+(?:19|20)\d{2}",
    RELATIVE,
    r"(?:with sources?|source links?|for beginners?|for kids|for students|step by step|in detail|briefly|short answer|quick answer)",
    r"for\s+(?:breakfast|lunch|dinner|brunch|date night|families|kids|students|beginners?)",
]


def query_target(x: Column) -> Column:
    """The thing a query is about: date, season and manner phrases at its end go, as often as they stand there."""
    t = F.regexp_replace(F.translate(s(x), "“”‘’", "\"\"''"), r"\s+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"^[\s\"'`]+|[\s\"'`]+$", ""), r"[?.!]+$", "")
    # the repeated stripping of one tail after another is one pattern of tails in a row, which must leave something
    t = F.regexp_replace(F.trim(t), rf"(?i)(?<=\S)(?:\s*,?\s+(?:{'|'.join(TAILS)}))+\s*$", "")
    t = F.regexp_replace(t, r"(?i)\s+(?:around|about|during|for|in|on|as of|by|before|after|from)\s*$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[?.!,;]+$", ""), r"\s+", " "))


def forget_key(x: Column) -> Column:
    t = trim(x)
    a = group(t, r"(?i)\bforget\s+(?:that\s+)?(?:my\s+)?(.+?)(?:\s+is\s+|\s+are\s+|$)")
    b = group(t, r"(?i)\b(?:forget|delete|remove|clear)\s+(?:that|this|the)?\s*(?:memory|memories)\b(?:\s+(?:about|for)\s+(.+))?$")
    return F.substring(F.trim(F.regexp_replace(F.when(a != "", a).otherwise(b), r"[?.!,;]+$", "")), 1, 80)


# --- source lists in answers --------------------------------------------------------------------------------------------


def source_line(x: Column) -> Column:
    """struct(title, url, domain) of a line: a markdown link, a bare URL with words, or words."""
    t = F.regexp_replace(F.regexp_replace(trim(x), r"^[-*•]\s*", ""), r"^\d+[.)]\s*", "")

    def read(r: Column) -> Column:
        t = r["t"]
        name, link = F.trim(group(t, r"^\[([^\]]+)\]\((https?://[^)\s]+)\)")), group(t, r"^\[([^\]]+)\]\((https?://[^)\s]+)\)", 2)
        raw = group(t, r"(?i)(https?://[^\s)]+)")
        url = F.regexp_replace(raw, "[.,;:]+$", "")
        rest = F.trim(F.regexp_replace(F.replace(t, raw, F.lit("")), r"[\s|—–-]+$", ""))
        out = lambda a, b: F.struct(a.alias("title"), b.alias("url"), urls.host(b).alias("domain"))
        return (
            F.when(t == "", F.lit(None)).when(link != "", out(name, link)).when(raw != "", out(F.when(rest != "", rest).otherwise(urls.host(url)), url)).otherwise(out(t, F.lit("")))
        )

    return let({"t": t}, read)


def split_sources(x: Column) -> Column:
    """struct(answer, sources): the text before a ``Sources:`` line, and up to eight source lines after it."""
    t = trim(x)
    marked = t.rlike(r"(?i)(?:^|\n)Sources:\s*\n?")
    answer = F.when(marked, trim(F.regexp_replace(F.regexp_replace(t, r"(?is)(?:^|\n)Sources:\s*\n?.*$", ""), r"\n{2,}", "\n\n"))).otherwise(t)
    block = F.regexp_extract(t, r"(?is)(?:^|\n)Sources:\s*\n(.*)$", 1)
    lines = F.slice(F.filter(F.transform(F.split(block, "\n"), lambda v: F.trim(v)), lambda v: (v != "") & ~v.rlike(r"(?i)^sources?:\s*$")), 1, 8)
    return F.struct(answer.alias("answer"), F.transform(lines, source_line).alias("sources"))


# --- fixed values: workflows ---------------------------------------------------------------------------------------------------

WORKFLOWS = [
    ("plan_weekend", r"(?i)\b(?:plan|suggest|build)\s+(?:my\s+|a\s+|the\s+)?(?:weekend|saturday|sunday|day\s+trip|2[\s-]?day|two[\s-]?day)\b"),
    ("compare_docs", r"(?i)\bcompare\s+(?:these|the|my|both|two)?\s*(?:files?|docs?|documents?|pdfs?|attachments?|versions?)\b"),
    ("fix_from_screen", r"(?i)\b(?:fix|debug|solve|resolve)\s+(?:this|the|my)?\s*(?:error|bug|issue|exception|stack\s*trace|problem)\b"),
]


def workflow(x: Column) -> Column:
    t = trim(x)
    return F.coalesce(*[F.when(has(t, p), F.lit(k)) for k, p in WORKFLOWS])


def budget(x: Column) -> Column:
    """struct(amount, currency, days, destination) of a budget question, with 1200, USD, 3 and "your destination" where it does not say."""
    t = s(x)
    phrase = r"(?i)\b(?:under|within|budget\s*(?:of)?|up to|max(?:imum)?(?: of)?)\s*(rs\.?|inr|usd|eur|gbp|\$)?\s*(\d+[\d,]*)\s*(usd|inr|eur|gbp)?\b"
    parts = {
        "said": group(t, phrase, 2), "before": group(t, phrase, 1), "after": group(t, phrase, 3),
        "dollars": group(t, r"\$\s*(\d+[\d,]*)"), "bare": group(t, r"(?i)\b(\d+[\d,]*)\s*(?:usd|inr|eur|gbp)\b"), "unit": group(t, r"(?i)\b\d+[\d,]*\s*(usd|inr|eur|gbp)\b"),
        "days": F.nullif(group(t, r"(?i)(\d+)\s*(?:days?|nights?)"), F.lit("")).cast("int"),
        "place": F.trim(group(t, r"(?i)\b(?:to|in)\s+([a-zA-Z][a-zA-Z\s,.-]{1,60}?)(?=\s+(?:for|under|within|budget|up to|max(?:imum)?|\d+\s*(?:days?|nights?))\b|$)")),
    }

    def read(r: Column) -> Column:
        amount = F.when(r["said"] != "", r["said"]).when(r["dollars"] != "", r["dollars"]).otherwise(r["bare"])
        unit = F.when(r["said"] != "", F.when(r["before"] == "$", F.lit("USD")).when(r["before"] != "", r["before"]).otherwise(r["after"])).when(r["dollars"] != "", F.lit("USD")).otherwise(r["unit"])
        unit = F.upper(unit)
        return F.struct(
            F.coalesce(F.nullif(F.replace(amount, F.lit(","), F.lit("")), F.lit("")).cast("double"), F.lit(1200.0)).alias("amount"),
            F.when(unit.isin("USD", "INR", "EUR", "GBP"), unit).otherwise("USD").alias("currency"),
            F.when(r["days"].isNull(), 3).otherwise(F.greatest(F.lit(1), r["days"])).alias("days"),
            F.when(r["place"] != "", r["place"]).otherwise("your destination").alias("destination"),
        )

    return let(parts, read)


# --- science read aloud -------------------------------------------------------------------------------------------------------

SCI = r"(?<![\w.])([-+]?(?:\d+(?:\.\d*)?|\.\d+))[eE]([-+]?)0*(\d+)"
UNITS = [
    (r"\bm/s\^?2\b", "meters per second squared"), (r"\bm/s\b", "meters per second"), (r"(?<=\d )kg\b", "kilograms"), (r"(?<=\d )C\b", "coulombs"), (r"(?<=\d )N\b", "newtons"), (r"(?<=\d )J\b", "joules"), (r"(?<=\d )Pa\b", "pascals"),
]


def speak_science(x: Column) -> Column:
    """Powers of ten, hex numbers, isotopes, formulas, arrows and exponents in words."""
    t = F.regexp_replace(s(x), SCI + r"(?=\s*[A-Za-z/^*]|\b|$)", "$1 times 10 to the $2$3")
    t = F.replace(t, F.lit("to the +"), F.lit("to the "))
    for p, words in UNITS:
        t = without(t, p, words)
    # every digit of a hex number gets a space before it, then the mark becomes a word
    t = F.regexp_replace(t, r"(?<=\b0x[0-9A-Fa-f]{0,16})(?=[0-9A-Fa-f])", " ")
    hexes = F.array_distinct(F.regexp_extract_all(t, F.lit(r"\b(0x(?: [0-9A-Fa-f])+)"), 1))
    t = F.aggregate(hexes, t, lambda acc, h: F.replace(acc, h, F.concat(F.lit("hex"), F.upper(F.substr(h, F.lit(3))))))
    t = F.regexp_replace(t, r"\b([A-Z][a-z]?)-(\d{1,3})\b", "$1 $2")
    formulas = F.array_distinct(F.regexp_extract_all(t, F.lit(r"\b((?=[A-Za-z0-9]*\d)(?:[A-Z][a-z]?\d*){2,}[+-]?)"), 1))
    spoken = lambda m: F.trim(F.regexp_replace(F.regexp_replace(m, r"([A-Z][a-z]?)(\d*)", "$1 $2 "), r"\s+", " "))
    t = F.aggregate(formulas, t, lambda acc, m: F.replace(acc, m, spoken(m)))
    t = F.regexp_replace(F.regexp_replace(t, "->|=>|⟶|→", " yields "), r"\^(-?\d+)", " to the $1")
    return collapse(t)


def token_class(x: Column) -> Column:
    t = s(x)
    return (
        F.when(t.rlike(r"^0x[0-9A-Fa-f]+$"), "hex")
        .when(t.rlike(r"^[-+]?(?:\d+(?:\.\d*)?|\.\d+)[eE][-+]?\d+"), "sci")
        .when(t.rlike(r"^(?:[A-Z][a-z]?)-\d{1,3}$"), "isotope")
        .when(t.rlike(r"^[-+]?\d+\.\d{4,}"), "decimal")
        .when(t.rlike(r"^(?:[A-Z][a-z]?\d*){2,}[+-]?$") & t.rlike(r"\d"), "chem")
        .otherwise("value")
    )

