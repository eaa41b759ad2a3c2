"""Answers and their evidence: which sources may stand behind an answer, how an answer is checked and finished."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls
from .text import collapse, count_words, group, has, mime_of, relevance_terms, s, trim, without

# --- fixed values: patterns --------------------------------------------------------------------------------

NEWS_REDIRECT = r"(?i)^https?://news\.google\.com/"
SEARCH_URL = r"search:|webcache|/search(?:[/?#]|$)|[?&]q="
ARCHIVES = r"archive\.(?:today|ph|is)|webcache"
WEB_KINDS = ("trusted_news", "public_news", "trusted_web", "web", "exa_trusted_web", "exa_web", "encyclopedia", "structured_reference", "cached_latest", "crawl4ai_grounded_source", "")
GENERIC_ADVICE = r"(?is)\b(check|visit|see|refer|search|google)\b.{0,120}\b(official website|website|site|source|sources|search|google|news websites?)\b|\b(steps you can follow|you can check|try searching|search online|look it up)\b"
UNCERTAIN = r"(?i)\b(i\s+(?:don'?t|do not)\s+know|i\s+(?:don'?t|do not)\s+have\s+(?:enough\s+)?(?:information|context|live|real[- ]?time)|not sure|cannot verify|can't verify|cannot confirm|can't confirm|might be outdated|may be outdated|i(?:'m| am)\s+unable\s+to\s+verify|i(?:'m| am)\s+not\s+certain|knowledge\s+cutoff|as\s+of\s+my\s+last\s+update|no\s+direct\s+information|unable\s+to\s+find\s+information)\b"
PORTFOLIO = r"(?s)\b(?:share|provide|give)\b.{0,40}\b(?:links?|urls?)\b.{0,40}\b(?:portfolio|github|linkedin|resume|cv|project)\b"
ASKS_SOURCES = [
    r"(?s)\b(?:could you|can you|please)\b.{0,40}\b(?:provide|share|give|send|paste)\b.{0,60}\b(?:source|sources|link|links|url|urls)\b",
    r"(?s)\bi (?:need|require|don'?t have|do not have)\b.{0,40}\b(?:source|sources|link|links|url|urls)\b",
    r"(?s)\b(?:upload|attach)\b.{0,40}\b(?:source|sources|link|links|url|urls)\b",
]
META_TALK = [
    r"(?s)\b(provided snippets?|supplied snippets?|provided text|retrieved context|search results?|top live snippets?|available snippets?|given snippets?|above snippets?)\b.{0,100}\b(do not|does not|don't|doesn't|do not state|do not name|do not mention|contain no|no information|do not specify|could not confirm|could not find|do not include|do not provide|only state|only mention)\b",
    r"^(the provided|based on the provided|according to the provided|the search results?|from the provided|the available|the retrieved|the supplied)\b",
    r"\b(snippets?|search results?) (do not|don't|only)\b",
]
META_LEAD = r"(?is)^(?:The provided snippets?|Based on the provided snippets?|According to the provided snippets?|The search results?|Based on the search results?|From the (?:provided|available|retrieved) (?:snippets?|context|text)).*?(?:\.|\n)\s*"
EXTRACT_FAILED = r"no readable text could be extracted|extraction failed|attached file:\s*.+\s*type:\s*|could not extract readable"
EXTRACT_REAL = r"\b(experience|education|skills|resume|curriculum|project|internship|objective|summary|email|phone|@)\b"
WHOLE_FILE = r"\b(analy[sz]e|review|summari[sz]e|explain|understand|read|see everything|whole|entire|full|overall|all pages?|attached file|attached document|pdf)\b"
IN_FILE = r"\b(find|extract|where|when|who|which|specific|date|dates|name|names|number|numbers|email|phone|address|section|clause|quote)\b"
FULL_MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
SHORT_MONTH = "(?:Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)"
DATES = [rf"(?i)\b({FULL_MONTH}\s+\d{{1,2}},\s+\d{{4}})\b", rf"(?i)\b(\d{{1,2}}\s+{FULL_MONTH}\s+\d{{4}})\b", rf"(?i)\b(\d{{1,2}}\s+{SHORT_MONTH}\s+\d{{4}})\b", rf"(?i)\b({SHORT_MONTH}\s+\d{{1,2}},\s+\d{{4}})\b"]
HANGING = r"(?i)(?:[,;:]|\.\.\.|[-–—(])$|\b(and|or|but|because|so|with|to|for|from|the|a|an|in|on|at|as|by|of|if|then|while|where|when|which|who|that|this|is|are|was|were|will|would|could|should|can|do|does|did|not)$"
COMMON_OPENERS = "In On At For By With From As The This That These Those According However Although While When Where Why How What Which Who Whom Whose If Unless Since Because".split()


def is_answer_source(title: Column, url: Column, description: Column, kind: Column, domain: Column, level: Column) -> Column:
    """May a source stand behind an answer: looser than citation, by type and length."""
    t, u, d, k = trim(title), trim(url), trim(description), trim(kind)
    dom = F.lower(F.when(s(domain) != "", s(domain)).otherwise(urls.host(u)))
    where = F.when(dom != "", dom).otherwise(F.lower(u))
    n, m = F.length(d), F.length(t)
    return (
        F.when(k.isin("archive_lookup", "community_discussion") | (u == "") | has(u, NEWS_REDIRECT), False)
        .when(has(F.lower(F.concat_ws(" ", t, u)), SEARCH_URL) | has(where, ARCHIVES), False)
        .when((s(level) == "structured_claim") | (k == "official_source"), True)
        .when(k == "reference_lookup", (n >= 40) | (m >= 12))
        .when(k.isin(*WEB_KINDS), (n >= 12) | (m >= 8))
        .otherwise((n >= 20) | (m >= 12))
    )


def is_final_source(message: Column, title: Column, description: Column, url: Column, domain: Column, kind: Column, trusted: Column) -> Column:
    """Any query term in the source, or a trusted type; deputies only where asked for."""
    words = relevance_terms(message)
    hay = F.lower(F.concat_ws(" ", s(title), s(description), s(domain)))
    deputy = ~has(F.lower(s(message)), r"\bdeputy\b") & has(F.lower(s(title)), r"\bdeputy\s+chief\s+minister\b")
    good = (F.size(words) == 0) | F.exists(words, lambda w: F.contains(hay, w)) | F.coalesce(trusted, F.lit(False)) | s(kind).isin("official_source", "trusted_news")
    return (trim(url) != "") & ~has(trim(url), NEWS_REDIRECT) & ~deputy & good


def is_crawlable(url: Column) -> Column:
    u = trim(url)
    return u.rlike(r"(?i)^https?://") & (urls.host(u) != "") & ~has(u, NEWS_REDIRECT) & ~u.rlike(r"(?i)\.pdf(?:$|[?#])") & ~has(urls.host(u), ARCHIVES) & ~F.lower(u).rlike(r"/search(?:[/?#]|$)|[?&]q=")


def lead_score(message: Column, title: Column, description: Column, domain: Column, kind: Column, trusted: Column) -> Column:
    words = relevance_terms(message)
    hay = F.lower(F.concat_ws(" ", s(title), s(description), s(domain)))
    n = F.size(F.filter(words, lambda w: F.contains(hay, w)))
    return F.when(n > 0, n * 2).when(F.size(words) > 0, -2).otherwise(0) + F.when(F.coalesce(trusted, F.lit(False)) | (s(kind) == "official_source"), 2).otherwise(0)


def asks_for_sources(x: Column) -> Column:
    t = F.lower(s(x))
    hit = F.lit(False)
    for p in ASKS_SOURCES:
        hit = hit | has(t, p)
    return hit & ~has(t, PORTFOLIO)


def escalation(answer: Column) -> Column:
    """Why a first answer needs retrieval; null where it may stand."""
    a = trim(answer)
    return (
        F.when(a == "", "empty_answer").when(asks_for_sources(a), "model_requested_sources_from_user").when(has(a, GENERIC_ADVICE), "generic_advice_answer").when(has(a, UNCERTAIN), "uncertain_or_evasive_answer")
    )


def is_meta_talk(x: Column) -> Column:
    t = F.lower(s(x))
    hit = F.trim(t) == ""
    for p in META_TALK:
        hit = hit | has(t, p)
    return hit


def strip_meta_talk(x: Column) -> Column:
    return F.trim(without(without(trim(x), META_LEAD), r"(?i)^(?:However|That said|Nevertheless|Nonetheless),?\s*"))


def metadata_only(x: Column) -> Column:
    t = F.lower(s(x))
    return (t == "") | (has(t, EXTRACT_FAILED) & ~has(t, EXTRACT_REAL))


def wants_ranking(x: Column) -> Column:
    """Does a question about an attachment ask for a part of it."""
    t = F.lower(collapse(x))
    return ~has(t, WHOLE_FILE) & has(t, IN_FILE)


def date_in(x: Column) -> Column:
    """The first date in one of four month formats; empty without one."""
    return F.coalesce(*[F.nullif(group(s(x), p), F.lit("")) for p in DATES], F.lit(""))


def alignment(truth: Column, response: Column) -> Column:
    """struct(anchor, accurate): does the first name of the truth's lead sentence occur, whole or in a part of three letters."""
    lead = F.regexp_extract(trim(truth), r"^([^.\n]*)", 1)
    lead = F.regexp_replace(lead, r"(?i)^(?:in\s+[a-z]+|according\s+to\s+[a-z]+|for\s+[a-z]+|as\s+of\s+[a-z]+|the\s+[a-z]+)[,:]?\s*", "")
    name = F.trim(group(lead, r"\b([A-Z][a-zA-Z.'’-]+(?:\s+[A-Z][a-zA-Z.'’-]+){0,4})\b"))
    name = F.when((name != "") & ~F.lower(name).isin([w.lower() for w in COMMON_OPENERS]), name)
    said = F.lower(trim(response))
    parts = F.filter(F.split(F.lower(name), " "), lambda p: F.length(p) >= 3)
    ok = (trim(truth) == "") | (said == "") | name.isNull() | F.contains(said, F.lower(name)) | F.exists(parts, lambda p: F.contains(said, p))
    return F.struct(name.alias("anchor"), ok.alias("accurate"))


def verification_query(question: Column, answer: Column) -> Column:
    """The question without its lead, and up to three names of the answer's first sentence; 100 characters at most."""
    q = F.regexp_replace(s(question), r"(?i)^(?:please\s+)?(?:can you\s+)?(?:tell me\s+)?(?:what is|who is|where is|when is|how is|which is)\s+", "")
    q = collapse(F.regexp_replace(q, r"[?!.,]+$", ""))
    first = collapse(F.regexp_extract(s(answer), r"^([^.\n]*)", 1))
    names = F.array_join(F.slice(F.array_distinct(F.regexp_extract_all(first, F.lit(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"), 1)), 1, 3), " ")
    both = F.concat_ws(" ", F.when(F.lower(q) != "unknown", F.nullif(q, F.lit(""))), F.nullif(F.when(names != "", names).otherwise(F.substring(first, 1, 60)), F.lit("")))
    out = F.substring(collapse(F.regexp_replace(both, r"[^A-Za-z0-9_\s-]", " ")), 1, 100)
    return F.when(out == "", "verify current factual claim").otherwise(out)


def complete(x: Column) -> Column:
    """Closes an odd code fence; ends a short sentence that is whole with a full stop."""
    t = trim(x)
    t = F.when(F.regexp_count(t, F.lit("```")) % 2 == 1, F.concat(t, F.lit("\n```"))).otherwise(t)
    seen = trim(F.regexp_replace(F.regexp_replace(t, r"(?s)```.*?```", " "), r"\[[^\]]+\]\([^)]+\)", "link"))
    tail = F.trim(F.regexp_extract(t, r"([^\n]*)\s*$", 1))
    linked = tail.rlike(r"(?i)^https?://|\[[^\]]+\]\(https?://[^)]+\)$") | (t.rlike(r"(?i)(?:^|\n)\s*Sources:\s*") & tail.rlike(r"(?i)https?://"))
    last = F.trim(F.regexp_extract(F.lower(seen), r"([^\n]*)\s*$", 1))
    keep = (seen == "") | linked | seen.rlike(r"[.!?。！？)\"'\]}]$") | has(last, HANGING) | (count_words(seen) >= 12)
    return F.when((t == "") | keep, t).otherwise(F.concat(t, F.lit(".")))


def attachment_kind(name: Column, mime: Column) -> Column:
    m = F.when(s(mime) != "", s(mime)).otherwise(mime_of(name))
    n = F.lower(s(name))
    return (
        F.when(F.lower(m).startswith("image/") | n.rlike(r"\.(?:png|jpe?g|webp|gif|bmp|heic)$"), "image")
        .when(n.endswith(".pdf") | (m == "application/pdf"), "pdf").when(n.rlike(r"\.docx?$"), "doc").when(n.rlike(r"\.pptx?$"), "ppt").otherwise("file")
    )


def verification_source(title: Column, url: Column, description: Column, text: Column) -> Column:
    """Fields with their caps of 180, 520 and 3500 characters."""
    t = collapse(title)
    return F.struct(
        F.substring(F.when(t == "", "Source").otherwise(t), 1, 180).alias("title"), trim(url).alias("url"), F.substring(collapse(description), 1, 520).alias("description"),
        F.substring(F.when(collapse(text) != "", collapse(text)).otherwise(collapse(description)), 1, 3500).alias("text"),
    )


def overlay_box(box: dict[str, Column]) -> Column:
    """struct(x, y, width, height) in units of the page from sides or sizes, in units or per cent; null where it is no box."""
    x, y, w, h, r, b = (box.get(k, F.lit(None)).cast("double") for k in ("x", "y", "width", "height", "right", "bottom"))
    w, h = F.coalesce(w, r - x), F.coalesce(h, b - y)
    k = F.when((x > 1) | (y > 1) | (w > 1) | (h > 1), 100.0).otherwise(1.0)
    unit = lambda v, low: F.greatest(F.lit(low), F.least(F.lit(1.0), v / k))
    return F.when(x.isNotNull() & y.isNotNull() & (w > 0) & (h > 0), F.struct(unit(x, 0.0).alias("x"), unit(y, 0.0).alias("y"), unit(w, 0.01).alias("width"), unit(h, 0.01).alias("height")))


GENERIC_LABEL = r"(?i)^(text|words|lettering|logo|label|screen|display|brand|writing|document|paper|sign|poster|banner|wallpaper)$"


def merge_objects(*lists: Column) -> Column:
    """Arrays of struct(label, count, confidence) as one, surest first, then most; unknown confidence last."""
    every = F.filter(F.concat(*lists), lambda o: F.trim(o["label"]) != "")
    keyed = F.transform(every, lambda o: F.struct((-F.coalesce(o["confidence"], F.lit(-1.0))).alias("a"), (-o["count"]).alias("b"), o.alias("o")))
    return F.transform(F.array_sort(keyed), lambda k: k["o"])


def top_object(objects: Column) -> Column:
    return F.filter(merge_objects(objects), lambda o: ~o["label"].rlike(GENERIC_LABEL))[0]


def objects_line(objects: Column) -> Column:
    return F.array_join(F.transform(F.slice(objects, 1, 4), lambda o: F.concat(o["label"], F.lit(" x"), F.greatest(F.lit(1), o["count"]).cast("string"))), ", ")
