"""Policies of chat: whether an answer needs live sources, how long it may be, and how reports of checks are put.

Rules that decide in order are lists of (condition, result); the first that holds wins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls
from .answers import date_in
from .dialogue import PLACE_TYPE, failure, place_evidence, place_topic, query_target
from .rules import CODING, intent
from .text import collapse, group, has, let, s, strip_tags, trim, without, word_request

# --- fixed values: questions whose answers do not change -----------------------------------------------------------

STABLE_NOT = [
    r"\b(?:who\s+is\s+(?:the\s+)?(?:current|present|latest)\s+(?:chief\s+minister|prime\s+minister|president|governor|mayor|chancellor|ceo|chairman|leader|head\s+of\s+state))\b",
    r"\b(?:who\s+is\s+(?:the\s+)?(?:cm|pm)\s+of)\b",
    r"\b(?:weather\s+in|forecast\s+for|temperature\s+in|stock\s+price|price\s+of\s+(?:bitcoin|btc|eth|solana|crypto|gold|silver|crude|shares?)|market\s+cap\s+of|live\s+score|ipl\s+(?:score|schedule|match|table)|breaking\s+news|today'?s\s+news|earthquake\s+today|election\s+results?\s+today)\b",
    r"\b(?:as\s+of\s+today|right\s+now|open\s+now|near\s+me|with\s+sources?|source\s+links?)\b",
    r"\b(?:what'?s\s+new|new\s+(?:update|updates|release|version|announcement|news|development|features?))\b",
    r"\b(?:directions\s+to|route\s+to|how\s+to\s+(?:reach|get\s+to)|hotels?\s+(?:near|around|in)|restaurants?\s+(?:near|around|in)|ticket\s+price|tickets?\s+for|entry\s+fee|visiting\s+hours|timings?\s+of|places\s+to\s+visit|things\s+to\s+do\s+in|sightseeing\s+in|near\s+me|nearby|near\s+[a-z]+)\b",
]
STABLE_ABOUT = [
    r"\b(?:capital\s+(?:city\s+)?of\s+[a-z\s.'-]+)",
    r"\b[a-z\s.'-]+\s+capital\b",
    r"\b(?:continent|continents|ocean|oceans|sea|seas|river|rivers|mountain|mountains|mountain\s+range|plateau|desert|island|islands|valley|gulf|bay|strait|peninsula|archipelago|hemisphere|equator|latitude|longitude|tropic\s+of\s+(?:cancer|capricorn)|longest\s+river|highest\s+mountain|deepest\s+ocean|largest\s+desert|largest\s+country|smallest\s+country|currency\s+of|official\s+language\s+of|national\s+animal|national\s+bird|national\s+flower|national\s+anthem|population\s+of|area\s+of|located\s+in|location\s+of|where\s+is\s+.+\s+located|where\s+are\s+.+\s+located)\b",
    r"\b(?:brihadeeswarar\s+temple|sun\s+temple|taj\s+mahal|eiffel\s+tower|colosseum|pyramids?\s+of\s+giza|angkor\s+wat|machu\s+picchu|stonehenge|parthenon|great\s+wall\s+of\s+china|statue\s+of\s+liberty|yosemite|grand\s+canyon|niagara\s+falls|mount\s+everest|marianas?\s+trench|louvre|central\s+park\s+design)\b",
    r"\b(?:history|ancient|medieval|century|empire|dynasty|civilization|battle\s+of|treaty\s+of|revolution|renaissance|archaeology|historical|cold\s+war|french\s+revolution|world\s+war|bronze\s+age|iron\s+age|mesopotamia|byzantine|ottoman|roman\s+empire|indus\s+valley|new\s+deal|new\s+kingdom|fdr|first\s+president\s+of|former\s+president|magna\s+carta|declaration\s+of\s+independence|constitution)\b",
    r"\b(?:physics|chemistry|biology|astronomy|cosmology|quantum|gravity|relativity|thermodynamics|optics|evolution|photosynthesis|mitosis|meiosis|dna|rna|gene|protein|cell|atom|molecule|neutron\s+star|black\s+hole|supernova|galaxy|planet|orbit|solar\s+system|exoplanet|speed\s+of\s+light|periodic\s+table|atomic\s+number|penicillin|who\s+discovered|who\s+invented|calculate|compute|solve|integrate|integral|derivative|differentiate|equation|formula|pythagorean|factorial|matrix|matrices|determinant|eigenvalue)\b",
    r"\b(?:definition\s+of|meaning\s+of|what\s+is\s+the\s+definition\s+of|what\s+is\s+the\s+meaning\s+of|define\s+|explain\s+(?:the\s+concept\s+of|what|how|why)|difference\s+between|philosophy|ethics|epistemology|metaphysics|stoicism|utilitarianism|existentialism|economics|macroeconomics|microeconomics|inflation|gdp)\b",
]
#: What ``STABLE_ABOUT[1]`` finds, without a try from every word of the run before: the last border of a word in that run is enough.
SOME_CAPITAL = r"[A-Za-z0-9_][\s.'-]+\scapital\b|(?<![A-Za-z0-9_])[a-z]+\scapital\b"
NAME_CAPITAL = r"\b(?:what\s+(?:is|was)|which\s+city\s+is|name)\s+(?:the\s+)?capital\s+(?:city\s+)?of\s+[a-z\s.'-]+"
SUM = r"^\s*[\d\s+\-*/^().=xXyYzZ]+\s*$"
PLAIN_QUESTION = r"(?i)^(?:where\s+is|where\s+was|where\s+are|what\s+is|what\s+was|what\s+are|what'?s|who\s+was|how\s+does|how\s+do|explain|define|tell\s+me\s+about)\s+[\w\s.'-]{2,80}\??$"

# --- fixed values: kinds of questions ----------------------------------------------------------------------------------

TIME_SENSITIVE = r"\b(latest|recent|current|today|now|update|updates|news|headlines|status|mission|launch|price|rate|score|result|election|breaking|as of|ipl|match|matches|fixture|fixtures|schedule|opening match|first match)\b"
INVENTED = r"\b(joke|poem|story|write|compose|roleplay|imagine)\b"
FACT_WORD = r"\b(who|what|when|where|which|how many|how much|date of|founded|ceo|president|prime minister|captain|winner|population|capital|currency|height|age|released|launch date)\b"
FACT_SHAPE = r"\b(is|are|was|were)\b.+\b\?\s*$"
DEFINITION_NOT = [
    r"\b(latest|today|current|right now|breaking|news|update|updates|score|price|rate)\b",
    r"\b(medical|medicine|medicines|dosage|dose|dosing|symptom|diagnos|treatment|legal|lawyer|contract|financial|investment|tax|self-harm|suicide|emergency)\b",
]
DEFINITION = [
    r"^(what is|what's|define|meaning of|explain)\b",
    r"(?i)^(?:can you\s+)?(?:explain\s+)?how\s+(?:does|do|is|are)?\s*[\w\"'.()\- ]{2,90}\s+works?\??$",
    r"(?i)^(?:can you\s+)?(?:explain\s+)?how\s+(?:does|do)\s+[\w\"'.()\- ]{2,90}\s+work\??$",
    r"\bdefinition of\b",
]
WITH_SOURCES = r"(?i)\b(with sources?|source links?)\b"
MUTABLE = [r"\b(with sources?|source links?)\b", r"\b(current|latest|today|now|as of)\b", r"\b(president|prime minister|chief minister|cm|governor|mayor|ceo|chairman|chairperson|captain|coach|ranking|standings|winner|score|price|rate|market cap|election result)\b"]
LIVE_CULTURE = r"(?i)\b(latest|current|news|today|now|with sources?|source links?)\b"

# --- fixed values: lengths and temperatures -----------------------------------------------------------------------------

BRIEF = r"\b(one line|one-liner|brief|briefly|short|tldr|tl;dr|in short|quickly|quick answer|concise|few words|keep it short|make it short)\b"
CREATIVE = r"\b(poem|poetry|story|stories|fiction|creative|brainstorm|imagine|roleplay|role play|lyrics|song|rap|joke|humor|witty|write a scene|short story|fairy tale|screenplay)\b"
FACTUAL = r"\b(who is|what is|when did|where is|define|definition|calculate|math|prove|formula|code|debug|fact|facts|capital of|population of|ceo of)\b"
STYLES = {"balanced": 0.6, "witty": 0.88, "chatty": 0.82, "supportive": 0.72, "debate": 0.78}
RECIPE = [
    r"\b(recipe|ingredients|steps|how to make|how do i make|how can i make|cook|prepare)\b",
    r"\b(biryani|chicken|mutton|rice|curry|masala|pasta|pizza|noodles|soup|cake|bread|dessert|dish|food|aloo|potato|fry|sabzi|poriyal|bhaji|stir fry|thalassery|tellicherry|tallessery|tallesery|talassery|malabar)\b",
]
TRIP = r"\b(itinerary|travel plan|trip plan|plan (?:a|an|my)?\s*trip|day plan|vacation)\b"
TRIP_FULL, TRIP_WORD = r"\b(detailed|comprehensive|full)\b", r"\b(trip|travel|visit|plan)\b"
TRIP_DEEP = r"\b(detailed|comprehensive|full|complete|in depth|deep)\b"
NUMBERS = "one two three four five six seven eight nine ten eleven twelve".split()
TRIP_DAYS = rf"\b(\d{{1,2}}|{'|'.join(NUMBERS)})\s+days?\b"
TRIP_DATES = r"\b(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\s+\d{1,2}\s*(?:-|–|to)\s*\d{1,2}\b"
FAST_INTENTS = ("fast_simple", "fast_explainer", "casual_chat", "chat_title")

# --- fixed values: commands, follow-ups, hedges ------------------------------------------------------------------------

SPEAK_IN = r"\b(?:switch|change|set|speak|talk)\s+(?:in|to|(?:the\s+)?language\s+to)\s+"
LANGUAGES = [
    ("ta-IN", "tamil", r"தமிழில்\s+பேசு|தமிழுக்கு\s+மாற்று"),
    ("te-IN", "telugu", r"தெலுங்கில்\s+பேசு|తెలుగులో\s+మాట్లాడు"),
    ("kn-IN", "kannada", r"கன்னடத்தில்\s+பேசு|ಕನ್ನಡದಲ್ಲಿ\s+ಮಾತನಾಡು"),
    ("hi-IN", "hindi", r"இந்தியில்\s+பேசு|हिंदी\s+में\s+बोलो"),
    ("en-US", "english", r"ஆங்கிலத்தில்\s+பேசு|ஆங்கிலத்திற்கு\s+மாற்று"),
]
SEEN_BARE = r"(?i)^(?:what about (?:that|this|it)|explain (?:that|this|it)(?: more)?|tell me more(?: about (?:that|this|it))?|zoom in on (?:that|this|it)|is (?:that|this) (?:safe|correct|right)|save (?:that|this)|verify (?:that|this|it)|check (?:that|this|it)|what(?:'s| is) (?:the )?(?:brand|model|text|error))\??$"
FILE_BARE = r"(?i)^(?:summari[sz]e (?:that|this|it|the above|the document)|key points(?: from (?:that|this|it|the above|the document))?|extract (?:the )?(?:dates?|names?|numbers?|text|details)|what does (?:that|this|it|the above|the document) say|verify (?:that|this|it|the above)|save (?:that|this|it)|explain (?:that|this|it|the above)|compare (?:that|this|it|the above)|make (?:that|this|it) better)\??$"
FILE_NAMED = r"(?i)\b(?:this|that|the|my|our|above|previous)\s+(?:resume|cv|document|file|pdf|attachment|docx?|pptx?|image|photo|screenshot|scan|page|form|table|chart)\b"
IMPROVE = r"(?i)\b(?:improv\w*|feedback|critique|review|rewrite|edit|strengthen|weak(?:ness(?:es)?)?|gaps?|missing|suggest(?:ions?)?|recommend(?:ations?)?|better|fix(?:es)?|polish|score|grade|rate|compare|explain|summari[sz]e|extract)\b"
IMPROVED = [r"(?i)\b(?:above|previous|earlier|same)\b", r"(?i)\b(resume|cv|document|file|pdf|attachment)\b", r"(?i)\b(this|that|it|these|those)\b"]
PICTURE = r"(?i)\b(image|photo|picture|screen|screenshot|camera|frame)\b"
FILE_ASK, FILE_POINT = r"(?i)\b(?:what about|how about|compare|explain|summari[sz]e|extract|make|rewrite|review|rate|score)\b", r"(?i)\b(?:it|this|that|above|same|them|those)\b"
SEND_AWAY = r"(?i)\b(check|consult|look up)\b.{0,40}\b(latest|official|source|news|website)\b"
NOT_SURE = r"(?i)\b(i am not sure|not certain|cannot verify|can't verify|unable to verify)\b"
GREETS = r"\b(how are you|what'?s up|hello|hi|thanks|thank you|are you there)\b"
ASKS_BACK = r"\b(what do you mean|clarify|did you mean|not sure|could you provide more context)\b"
CARDS = ("network_timeout", "model_empty", "retrieval_empty", "permission_blocked")
VERDICTS = {"likely accurate": "Accurate", "incorrect": "Inaccurate", "unsupported": "Unverified", "partly accurate": "Misleading", "accurate": "Accurate", "inaccurate": "Inaccurate", "outdated": "Outdated", "unverified": "Unverified", "misleading": "Misleading"}
VERDICT = rf"(?im)^(\s*Verdict:\s*)({'|'.join(VERDICTS)})\b"
CLAIMS_NOW = r"(?i)\b(current|today|now|presently|incumbent|latest|live|as of today)\b"
SOURCES_HEAD = r"(?:^|\n)\s*Sources(?:\s+used)?:\s*"
PLACE_ASKED = r"(?i)\b(?:in|at|for|near|around)\s+([a-zA-Z][a-zA-Z\s.,'-]{1,80})$"
PLACE_NOISE = r"(?i)\b(latest|current|today|now|near me|open now|best|top|show me|find|search)\b"
PLACE_AFTER = r"(?i)\b(?:in|at|near|around)\s+(.+)$"
VISION_NOISE = [
    (r"(?i)^```(?:json)?\s*", ""), (r"(?i)\s*```$", ""),
    (r"(?is)\b\"?(?:objects|people|animals|textDetected|modelEvidence|distinctiveFeatures|confidence)\"?\s*:\s*(?:\[.*?\]|\{.*?\}|[0-9.]+|\"[^\"]*\")\s*,?", " "),
    (r"(?i)\"(?:answer|summary|mainSubject|subjectType|conditionOrState|likelyReason|careOrSafetyNote|brand|model|uncertainty|fullText|label|count)\"\s*:\s*\"?", " "),
    (r"(?i)\bConfidence:\s*[^\n.]+\.?", " "), (r"[{}\[\]]", " "), (r"\"\s*,\s*\"", " "), (r"\"\s*:\s*\"", ": "), (r"(^|[\s,])\"", "$1"), (r"\"([\s,.]|$)", "$1"), (r"\s+", " "),
]


def any_of(x: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, p: a | has(x, p), patterns, F.lit(False))


def first_of(rules: list[tuple[Column, Column]], default: Column) -> Column:
    out = F.when(F.lit(False), default)
    for condition, value in rules:
        out = out.when(condition, value)
    return out.otherwise(default)


# --- kinds of questions ---------------------------------------------------------------------------------------------


def is_stable_fact(x: Column) -> Column:
    """Asks for knowledge that does not change, and not for anything live."""

    def decide(r: Column) -> Column:
        t, low = r["t"], r["low"]
        known = any_of(low, [NAME_CAPITAL, STABLE_ABOUT[0], SOME_CAPITAL, *STABLE_ABOUT[2:]]) | any_of(t, [SUM, *CODING, PLAIN_QUESTION])
        return (t != "") & known & ~any_of(low, STABLE_NOT)

    return let({"t": trim(x)}, lambda r: let({"t": r["t"], "low": F.trim(F.regexp_replace(F.lower(r["t"]), r"[?!.,;:]+$", ""))}, decide))


def is_time_sensitive(x: Column) -> Column:
    return has(F.lower(s(x)), TIME_SENSITIVE)


def is_factual(x: Column) -> Column:
    # the shape ends in a question mark; a text that does not is not searched for it
    shape = lambda t: has(t, r"\?\s*$") & has(t, FACT_SHAPE)
    return let({"t": F.lower(trim(x))}, lambda r: (r["t"] != "") & ~has(r["t"], INVENTED) & (has(r["t"], FACT_WORD) | shape(r["t"])))


def is_definition(x: Column) -> Column:
    return let({"t": F.lower(trim(x))}, lambda r: any_of(r["t"], DEFINITION) & ~any_of(r["t"], DEFINITION_NOT))


def is_mutable_fact(x: Column) -> Column:
    return let({"x": x, "t": F.lower(s(x))}, lambda r: any_of(r["t"], MUTABLE) & (trim(r["t"]) != "") & ~is_stable_fact(r["x"]))


def routing(x: Column, purpose: Column | None = None, grounded: Column | None = None, summary: Column | None = None, live: bool = True, strict: bool = True) -> Column:
    """struct(strategy, reason, web): answer directly, search first, or answer and search if the answer falls short.

    ``live``: is a search configured; ``strict``: one pass only, so facts that may change are searched at once.
    """
    no = F.lit(False)
    what = s(purpose) if purpose is not None else F.lit("")
    parts = {"t": trim(x), "i": intent(x), "purpose": what, "grounded": grounded if grounded is not None else no, "summary": summary if summary is not None else no}

    def decide(r: Column) -> Column:
        t, kind, category = r["t"], r["i"]["type"], r["i"]["category"]
        searched = "live_first" if live else "direct"
        off = "live_retrieval_disabled"
        facts = [(is_mutable_fact(t), "live_first", "mutable_factual_query"), (no | True, "direct", "stable_factual_query")] if strict else [(no | True, "direct_then_live_if_needed", "factual_query")]
        table = [
            (r["purpose"] == "chat_title", "direct", "chat_title_generation"),
            (r["grounded"] | r["purpose"].startswith("selection_"), "direct", "attachment_or_selection_grounded"),
            (r["summary"], "direct", "internal_summarizer_prompt"),
            (t == "", "direct", "empty_query"),
            ((r["purpose"] == "pop_culture_reference") & has(t, LIVE_CULTURE), "live_first", "time_sensitive_query"),
            (r["purpose"] == "pop_culture_reference", "direct", "pop_culture_reference_stable"),
            (kind == "temporal_fact", searched, "temporal_fact_separator" if live else off),
            ((kind == "static_reasoning") & (category != "general_reasoning"), "direct", F.concat(F.lit("static_"), category)),
            (is_stable_fact(t), "direct", "static_general_knowledge"),
            *([] if live else [(no | True, "direct", off)]),
            (has(t, WITH_SOURCES), "live_first", "user_requested_sources"),
            (is_time_sensitive(t), "live_first", "time_sensitive_query"),
            (is_definition(t), "direct", "stable_definition_query"),
            *[(c & is_factual(t), a, b) for c, a, b in facts],
        ]

        def row(strategy: str, reason: str | Column) -> Column:
            return F.struct(F.lit(strategy).alias("strategy"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"), F.lit(strategy != "direct").alias("web"))

        return first_of([(c, row(a, b)) for c, a, b in table], row("direct", "casual_or_non_factual"))

    return let(parts, decide)


# --- lengths ---------------------------------------------------------------------------------------------------------


def detail_level(x: Column, wished: Column | None = None, high: Column | None = None) -> Column:
    """short or detailed: a word limit of at most 80, then the user's setting, then the question's words. ``high`` is the word limit, for callers that have it."""
    high, wish = word_request(x)["high"] if high is None else high, F.lower(s(wished)) if wished is not None else F.lit("")
    return F.when(F.coalesce(high <= 80, F.lit(False)), "short").when(wish.isin("short", "detailed"), wish).when(has(F.lower(s(x)), BRIEF), "short").otherwise("detailed")


def temperature(x: Column, purpose: Column, style: Column, detail: Column, structured: Column) -> Column:
    low, p = F.lower(s(x)), s(purpose)
    base = F.coalesce(F.create_map(*[F.lit(v) for kv in STYLES.items() for v in kv])[F.lower(s(style))], F.lit(STYLES["balanced"]))
    rules = [
        (structured | p.isin("chat_title", "verify_answer"), F.lit(0.2)),
        (p == "fast_explainer", F.lit(0.4)),
        (has(low, CREATIVE), F.lit(0.92)),
        (has(low, FACTUAL), F.lit(0.35)),
        (detail == "short", F.least(base, F.lit(0.5))),
    ]
    return first_of(rules, base)


def is_recipe(x: Column) -> Column:
    t = F.lower(s(x))
    return has(t, RECIPE[0]) & has(t, RECIPE[1])


def is_long_trip(x: Column) -> Column:
    """A travel plan that is detailed, has a range of dates, or takes four days or more."""

    def lasts(r: Column) -> Column:
        days = r["days"]
        n = F.coalesce(F.expr("NULL").cast("int"), *[F.when(days == w, F.lit(i)) for i, w in enumerate(NUMBERS, start=1)], F.when(days != "", days.try_cast("int")))
        return F.coalesce(n >= 4, F.lit(False))

    def decide(r: Column) -> Column:
        t = r["t"]
        plan = has(t, TRIP) | (has(t, TRIP_FULL) & has(t, TRIP_WORD))
        return plan & (has(t, TRIP_DATES) | has(t, TRIP_DEEP) | let({"days": group(t, TRIP_DAYS)}, lasts))

    return let({"t": F.regexp_replace(F.lower(s(x)), r"\b(itenary|itenarary)\b", "itinerary")}, decide)


def length_policy(x: Column, purpose: Column, style: Column, wished: Column, structured: Column) -> Column:
    """struct(kind, max_tokens, temperature) of an answer."""
    parts = {"t": s(x), "p": s(purpose), "style": s(style), "wish": s(wished), "structured": structured, "spec": word_request(x)}

    def decide(r: Column) -> Column:
        t, p, high = r["t"], r["p"], r["spec"]["high"]
        detail = detail_level(t, r["wish"], high)

        def row(kind: str, tokens: int | Column, level: str | Column, exact: bool = False) -> Column:
            level = F.lit(level) if isinstance(level, str) else level
            heat = temperature(t, p, r["style"], level, F.lit(exact))
            return F.struct(F.lit(kind).alias("kind"), (F.lit(tokens) if isinstance(tokens, int) else tokens).cast("int").alias("max_tokens"), heat.alias("temperature"))

        words = F.least(F.lit(16000), F.greatest(F.lit(600), F.floor(high * 2.6 + 400 + 0.5)))
        table = [
            (p == "chat_title", row("title", 120, "short", True)),
            (r["structured"], row("structured", 2000, "short", True)),
            (r["spec"].isNotNull(), row("words", words, F.when(high <= 80, "short").otherwise("detailed"))),
            (p == "fast_explainer", row("explainer", 2000, "short")),
            (is_recipe(t), row("recipe", 10000, detail)),
            (is_long_trip(t), row("trip", 14000, detail)),
            (detail == "short", row("short", 2000, "short")),
        ]
        return first_of(table, row("detailed", 12000, detail))

    return let(parts, decide)


def cost_cap(tokens: Column, purpose: Column, stream: Column, fast: int, streamed: int, other: int) -> Column:
    """Tokens under the cap of an intent: ``fast`` for quick answers, ``streamed``, or ``other``."""
    cap = F.when(s(purpose).isin(*FAST_INTENTS), F.lit(fast)).when(stream, F.lit(streamed)).otherwise(F.lit(other))
    return F.least(F.least(F.lit(16000), F.greatest(F.lit(256), F.coalesce(tokens, cap))), cap)


# --- commands and follow-ups -------------------------------------------------------------------------------------------


def language_command(x: Column) -> Column:
    """The locale a message asks to speak in; null where it asks for none."""
    t = F.lower(trim(x))
    return F.coalesce(*[F.when(has(t, rf"{SPEAK_IN}{name}\b") | t.rlike(native), F.lit(code)) for code, name, native in LANGUAGES])


def is_seen_follow_up(x: Column, kind: Column) -> Column:
    """Does a message go on about an attachment or a picture (``kind``: attachment, vision, or nothing)."""
    t, k = trim(x), F.lower(s(kind))
    bare = has(t, SEEN_BARE) | has(t, FILE_BARE)
    about = has(t, FILE_NAMED) | (has(t, IMPROVE) & any_of(t, IMPROVED)) | ((k == "vision") & has(t, PICTURE)) | ((k == "attachment") & has(t, FILE_ASK) & has(t, FILE_POINT)) | (has(t, r"(?i)\b(this|that|it)\b") & (F.length(t) <= 160))
    return F.length(t).between(1, 320) & (bare | (k.isin("attachment", "vision") & about))


def location_in(x: Column) -> Column:
    """The place after in, at, for, near or around at the end of a question."""
    return query_target(group(F.regexp_replace(trim(F.regexp_replace(s(x), r"[?.!]+$", "")), r"\s+", " "), PLACE_ASKED))


def place_asked(x: Column) -> Column:
    t = collapse(without(s(x), PLACE_NOISE, " "))
    after = group(t, PLACE_AFTER)
    return F.substring(query_target(F.when(after != "", after).otherwise(t)), 1, 120)


def is_relevant_place(query: Column, title: Column, description: Column) -> Column:
    """Two thirds of the topic's words, rounded up, in a result; two words at least where a kind of place is asked for."""
    e = place_evidence(query, title, description)
    parts = {"e": e, "n": F.size(F.filter(F.split(place_topic(query), r"\s+"), lambda w: F.length(w) > 2)), "typed": has(s(query), PLACE_TYPE)}

    def decide(r: Column) -> Column:
        score, n = r["e"]["score"], r["n"]
        enough = (score >= F.ceil(n * 0.67) / n) & (~r["typed"] | (score >= F.least(F.lit(1.0), 2 / F.greatest(n, F.lit(1)))))
        return F.coalesce(r["e"]["exactish"] | ((r["e"]["level"] != "none") & (n > 0) & enough), F.lit(False))

    return let(parts, decide)


def holds_any(x: Column, terms: Column) -> Column:
    """Does a text hold any of the terms; no terms ask for nothing."""
    low = F.lower(s(x))
    return (F.size(terms) == 0) | F.exists(terms, lambda t: F.contains(low, t))


# --- answers --------------------------------------------------------------------------------------------------------------


def shows_failure_card(message: Column, said: Column, code: Column | None = None, simple: Column | None = None) -> Column:
    t = F.lower(collapse(said))
    calm = F.coalesce(simple, F.lit(False)) if simple is not None else F.lit(False)
    return failure(message, code).isin(*CARDS) & (t != "") & ~calm & ~has(t, GREETS) & ~has(t, ASKS_BACK)


def sanitized(x: Column) -> Column:
    """A retrieved answer, empty where it hedges or sends the reader elsewhere; ends in a full stop."""
    t = collapse(x)
    return F.when((t == "") | has(t, SEND_AWAY) | has(t, NOT_SURE), "").when(t.endswith("."), t).otherwise(F.concat(t, F.lit(".")))


def vision_text(x: Column) -> Column:
    """A picture's description without the JSON around it."""
    return F.substring(trim(reduce(lambda t, p: without(t, *p), VISION_NOISE, trim(x))), 1, 1200)


def with_sources(x: Column, lines: Column) -> Column:
    """A report whose ``Sources used`` section is the given lines, in place of the one it has."""
    section = F.when(F.size(lines) > 0, F.concat(F.lit("Sources used:\n"), F.array_join(F.slice(lines, 1, 6), "\n"))).otherwise("Sources used: No retrieved sources were available.")
    body = F.regexp_replace(trim(x), rf"(?is){SOURCES_HEAD}.*$", "")
    return trim(F.concat(body, F.when(trim(x).rlike(f"(?i){SOURCES_HEAD}"), F.lit("\n")).otherwise(F.lit("\n\n")), section))


def source_lines(sources: Column) -> Column:
    """Numbered links of up to six sources (structs with title and url) that have a web address."""
    web = F.slice(F.filter(sources, lambda x: s(x["url"]).rlike("(?i)^https?://")), 1, 6)
    return F.transform(web, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". ["), F.when(s(x["title"]) == "", F.concat(F.lit("Source "), i + 1)).otherwise(collapse(x["title"])), F.lit("]("), F.trim(x["url"]), F.lit(")")))


def compact_report(x: Column, sources: Column) -> Column:
    """Two lines of a report: how it was checked, and its sources."""
    parts = {"t": with_sources(x, source_lines(sources)), "any": F.exists(sources, lambda v: s(v["url"]).rlike("(?i)^https?://"))}

    def put(r: Column) -> Column:
        how = collapse(F.regexp_extract(r["t"], r"(?is)(?:^|\n)\s*How checked:\s*(.*?)(?:\n\s*(?:Sources(?:\s+used)?|Verdict|Claims checked|Evidence used|Claims needing|Corrected answer):|$)", 1))
        plain = F.when(r["any"], "I compared the answer with the retrieved source evidence.").otherwise("I could not check the answer against retrieved sources because none were available.")
        listed = trim(F.regexp_extract(r["t"], rf"(?is){SOURCES_HEAD}(.*)$", 1))
        return F.concat(F.lit("How checked: "), F.when(how != "", how).otherwise(plain), F.lit("\nSources used: "), listed)

    return let(parts, put)


def verdict_labels(x: Column, has_evidence: Column) -> Column:
    """One of five verdict labels; what is said of the present is unverified without evidence."""
    label = F.create_map(*[F.lit(v) for kv in VERDICTS.items() for v in kv])[F.lower(F.regexp_extract(trim(x), VERDICT, 2))]
    now_only = ~has_evidence & has(trim(x), CLAIMS_NOW)
    named = F.when(now_only, "Unverified").otherwise(label)
    parts = {"t": trim(x), "label": named}

    def put(r: Column) -> Column:
        # the label is put by parts: text before the verdict, its lead, and the rest
        m = r"(?is)^(.*?(?:^|\n)\s*Verdict:\s*)(?:" + "|".join(VERDICTS) + r")\b(.*)$"
        lead, rest = F.regexp_extract(r["t"], m, 1), F.regexp_extract(r["t"], m, 2)
        return F.when(r["t"] == "", "").when(r["label"].isNotNull(), F.concat(lead, r["label"], rest)).otherwise(F.concat(F.lit("Verdict: Unverified.\n"), r["t"]))

    return let(parts, put)


def date_across(sources: Column) -> Column:
    """The first date in the titles and descriptions of the first six sources."""
    found = F.transform(F.slice(sources, 1, 6), lambda x: date_in(F.concat_ws(" ", s(x["title"]), s(x["description"]))))
    return F.coalesce(F.get(F.filter(found, lambda d: d != ""), F.lit(0)), F.lit(""))


def update_line(message: Column, title: Column, description: Column, sources: Column) -> Column:
    """One sentence of news; a question for a time gets the reported date."""
    name = F.trim(F.regexp_replace(s(title), r"[.\s]+$", ""))
    lead = F.trim(F.split(s(description), r"[.!?]\s", 2)[0])
    own = date_in(F.trim(F.concat_ws(" ", name, lead)))
    parts = {"m": F.lower(s(message)), "name": name, "lead": lead, "date": F.when(own != "", own).otherwise(date_across(sources))}

    def put(r: Column) -> Column:
        when = has(r["m"], r"^\s*when\b")
        return (
            F.when(when & (r["date"] != ""), F.concat(F.lit("the reported date is "), r["date"], F.lit(" ("), r["name"], F.lit(").")))
            .when(when, "I could not confirm an exact date from the top live snippets.")
            .when((F.length(r["lead"]) >= 25) & ~r["lead"].rlike("(?i)^https?://"), F.concat(r["name"], F.lit(". "), r["lead"], F.lit(".")))
            .otherwise(F.concat(F.lit("the latest update is: "), r["name"], F.lit(".")))
        )

    return let(parts, put)


def capped(x: Column, limit: int) -> Column:
    return F.substring(trim(x), 1, limit)


def selection_grounding(kind: Column, selected: Column, answer: Column) -> Column:
    """struct(kind, selected, answer): a selection's texts under their limits, which attachments have wider; either stands in for the other."""
    file = F.lower(trim(kind)) == "attachment"
    either = lambda a, b: F.when(s(a) != "", s(a)).otherwise(s(b))
    cut = lambda x, n: F.when(file, capped(x, 60_000)).otherwise(capped(x, n))
    return F.struct(F.when(trim(kind) == "", "selection").otherwise(F.lower(trim(kind))).alias("kind"), cut(either(selected, answer), 4000).alias("selected"), cut(either(answer, selected), 10_000).alias("answer"))


def verification_sources(sources: Column) -> Column:
    """Up to six web sources (structs with title, url, description, text) with their fields under the limits of a check."""
    cut = F.transform(
        sources,
        lambda x: F.struct(
            capped(F.when(s(x["title"]) == "", "Source").otherwise(x["title"]), 180).alias("title"),
            capped(x["url"], 1000).alias("url"),
            capped(x["description"], 800).alias("description"),
            capped(x["text"], 3500).alias("text"),
        ),
    )
    return F.slice(F.filter(cut, lambda x: (x["title"] != "") & x["url"].rlike("(?i)^https?://")), 1, 6)


def source_items(sources: Column) -> Column:
    """Up to eight sources as title, url, domain; a source without a title goes by its host."""
    return F.slice(
        F.transform(
            sources,
            lambda x: F.struct(
                F.coalesce(F.nullif(trim(x["title"]), F.lit("")), F.nullif(urls.host(trim(x["url"])), F.lit("")), F.lit("Source")).alias("title"), trim(x["url"]).alias("url"), urls.host(trim(x["url"])).alias("domain")
            ),
        ),
        1,
        8,
    )


# How a source of each type is quoted, and the provider named with it.
TEMPLATES = [
    ("free_weather", "open_meteo_source"), ("free_crypto_price", "coingecko_source"), ("free_disaster_event", "nasa_eonet_source"), ("free_reference", "public_place_source"), ("free_place_data", "public_place_source"),
    ("free_sports_reference", "sports_reference_source"), ("cached_latest", "latest_cache_source"), ("official_source", "public_source_result"), ("trusted_news", "public_source_result"), ("public_news", "public_source_result"),
    ("encyclopedia", "public_source_result"), ("structured_reference", "public_source_result"),
]


def source_answer(kind: Column, title: Column, description: Column, date: Column, label: Column) -> Column:
    """struct(answer, provider) out of one source: its title, what belongs to its type in brackets, and its description; null for other types."""
    parts = {"k": trim(kind), "t": collapse(title), "d": collapse(description), "date": F.substring(trim(date), 1, 10), "label": collapse(label)}

    def put(r: Column) -> Column:
        aside = F.when(r["k"] == "free_disaster_event", r["date"]).when(r["k"] == "cached_latest", r["label"]).otherwise("")
        aside = F.when(aside != "", F.concat(F.lit(" ("), aside, F.lit(")"))).otherwise("")
        text = F.concat(r["t"], aside, F.when(r["d"] != "", F.concat(F.lit(": "), r["d"])).otherwise(""))
        provider = F.create_map(*[F.lit(v) for kv in TEMPLATES for v in kv])[r["k"]]
        return F.when(((r["t"] != "") | (r["d"] != "")) & provider.isNotNull(), F.struct(text.alias("answer"), provider.alias("provider")))

    return let(parts, put)


def encyclopedia_row(title: Column, url: Column, extract: Column) -> Column:
    """struct(title, url, description, domain) of an encyclopedia entry; without an address one is made of its title."""
    made = F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.url_encode(F.regexp_replace(trim(title), r"\s+", "_")))
    link = F.when(trim(url) != "", trim(url)).when(trim(title) != "", made).otherwise("")
    return F.struct(trim(title).alias("title"), link.alias("url"), trim(strip_tags(extract)).alias("description"), urls.host(link).alias("domain"))


def live_policy(message: Column, answer: Column, n_sources: Column, strategy: Column, attempted: Column) -> Column:
    """What becomes of an answer once sources are there: keep it, live_update (rewrite from sources), or unavailable (say that none was found)."""
    from .answers import asks_for_sources

    asks_user, none = asks_for_sources(answer), n_sources <= 0
    rules = [
        (is_stable_fact(message), F.lit("keep")),
        ((strategy == "direct") & ~attempted & none, F.lit("keep")),
        (asks_user & ~none, F.lit("live_update")),
        (asks_user & (attempted | (strategy == "live_first")), F.lit("unavailable")),
        (asks_user | ~is_time_sensitive(message), F.lit("keep")),
        (~none, F.lit("live_update")),
        (attempted & (trim(answer) == ""), F.lit("unavailable")),
    ]
    return first_of(rules, F.lit("keep"))


SORRY = "I could not generate a response this time. Please try again."  # fixed value


def model_reply(x: Column) -> Column:
    """struct(intent, response, thought) of a model's text: plain words, an object with an answer, or a query to lay out."""
    from .text import think_parts

    def read(r: Column) -> Column:
        said, body = r["said"], r["body"]
        get = lambda path: F.get_json_object(body, f"$.{path}")
        listed = lambda path: F.from_json(F.coalesce(get(path), F.lit("[]")), "array<string>")
        whole = body.rlike(r"(?s)^\s*\{.*\}\s*$") & F.try_parse_json(body).isNotNull()
        is_query = (s(get("query")) != "") & (get("query_type").isNotNull() | get("tables_used").isNotNull() | get("validation_status").isNotNull())
        valid = s(get("validation_status.is_valid")) != "false"
        notes = F.array_join(F.transform(listed("execution_notes"), lambda n: F.concat(F.lit("- "), n)), "\n")
        layout = F.array_join(
            F.array_compact(
                F.array(
                    F.concat(F.lit("```sql\n"), F.trim(get("query")), F.lit("\n```")),
                    F.concat(F.lit("**Query Type:** "), F.upper(F.coalesce(get("query_type"), F.lit("SELECT")))),
                    F.concat(F.lit("**Tables Used:** "), F.when(F.size(listed("tables_used")) > 0, F.array_join(listed("tables_used"), ", ")).otherwise("N/A")),
                    F.concat(F.lit("**Estimated Complexity:** "), F.coalesce(get("estimated_complexity"), F.lit("Normal"))),
                    F.when(valid, "**Syntax Validation:** Passed").otherwise(F.concat(F.lit("**Syntax Errors:** "), F.array_join(F.filter(listed("validation_status.syntax_errors"), lambda e: e != ""), ", "))),
                    F.when(notes != "", F.concat(F.lit("\n**Execution Notes:**\n"), notes)),
                )
            ),
            "\n",
        )
        told = F.coalesce(F.nullif(trim(get("response")), F.lit("")), F.nullif(trim(get("text")), F.lit("")), F.lit(SORRY))
        kind = F.coalesce(F.nullif(trim(get("intent")), F.lit("")), F.lit("casual_chat"))
        out = lambda a, b: F.struct(a.alias("intent"), b.alias("response"), r["p"]["thought"].alias("thought"))
        return (
            F.when(said == "", out(F.lit("service_unavailable"), F.lit(SORRY)))
            .when(~F.coalesce(whole, F.lit(False)), out(F.lit("casual_chat"), body))
            .when(is_query, out(F.lit("sql_generation"), layout))
            .otherwise(out(kind, told))
        )

    def fenced(r: Column) -> Column:
        return let({"p": r["p"], "said": r["said"], "fenced": F.regexp_extract(r["said"], r"(?is)```(?:json)?\s*(\{.*?\})\s*```", 1)}, lambda r: let({"p": r["p"], "said": r["said"], "body": F.when(r["fenced"] != "", r["fenced"]).otherwise(r["said"])}, read))

    said = lambda p: F.when(p["response"] != "", p["response"]).otherwise(p["thought"])
    return let({"p": think_parts(x)}, lambda r: let({"p": r["p"], "said": said(r["p"])}, fenced))


def overlay_items(items: Column) -> Column:
    """Marks on a page (structs with label, x, y, width, height) that have a label and a box, at most 24, labels of at most 180 characters."""
    from .answers import overlay_box

    def one(x: Column) -> Column:
        return F.struct(F.substring(collapse(x["label"]), 1, 180).alias("label"), overlay_box({k: x[k] for k in ("x", "y", "width", "height")}).alias("box"))

    return F.slice(F.filter(F.transform(items, one), lambda x: (x["label"] != "") & x["box"].isNotNull()), 1, 24)


def merged_pdf_text(layer: Column, server: Column, seen: Column) -> Column:
    """The texts of a PDF's own layer, the server's reading and the pictures' reading as one, near-duplicates left out."""
    from ..operators.rank import dedupe_sections

    return F.array_join(dedupe_sections(F.array(s(layer), s(server), s(seen))), "\n\n")
