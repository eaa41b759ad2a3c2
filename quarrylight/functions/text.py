"""Text, markup, token and number functions, Column in and Column out.

White space is Unicode white space and the byte-order mark. Nulls count as the empty string unless said.
Lengths count code points.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)[\s\x{FEFF}]"

#: A word boundary between ASCII word characters and others. Java's own ``\b`` takes accented letters for
#: word characters on some versions, where the rules here mean ASCII.
BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


#: Atoms that take an ASCII word character, and the class of what they take.
_ATOM = re.compile(r"([A-Za-z0-9_])|\\(d)|\\(w)|\[((?:[A-Za-z0-9]-[A-Za-z0-9]|[A-Za-z0-9_])+)\]")
_STEP = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|.", re.S)


def _leads(p: str, i: int) -> str | None:
    """The characters of a class that a match of ``p`` from ``i`` on starts with; None unless all are ASCII word characters and there is always one."""
    if p[i : i + 1] == "(":
        i += 3 if p.startswith("(?:", i) else 1
        if p[i : i + 1] == "?":
            return None
        found, depth = [_leads(p, i)], 0
        while i < len(p) and (depth or p[i] != ")"):
            step = _STEP.match(p, i).group()
            depth += (step == "(") - (step == ")")
            i += len(step)
            if step == "|" and not depth:
                found.append(_leads(p, i))
        out, i = None if None in found else "".join(found), i + 1
    else:
        m = _ATOM.match(p, i)
        out, i = (m[1] or (m[2] and "0-9") or (m[3] and "A-Za-z0-9_") or m[4], m.end()) if m else (None, i)
    return None if p[i : i + 1] in ("?", "*") or p[i : i + 2] in ("{0", "{,") else out


@cache
def ascii_words(pattern: str) -> str:
    """The pattern with ASCII word boundaries. Where a word has to start at one, its first letters (of either case) and the character before decide: most places of a text are left after one look."""
    first, *rest = pattern.split(r"\b")
    out, at = first, len(first)
    for part in rest:
        at += 2
        lead = None if "(?U)" in pattern else _leads(pattern, at)
        out += f"(?=[{''.join(dict.fromkeys(re.findall('.-.|.', lead.lower() + lead.upper())))}])(?<![A-Za-z0-9_])" if lead else BOUNDARY
        out, at = out + part, at + len(part)
    return out


def has(x: Column, pattern: str) -> Column:
    return x.rlike(ascii_words(pattern))


def group(x: Column, pattern: str, n: int = 1) -> Column:
    return F.regexp_extract(x, ascii_words(pattern), n)


def without(x: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(x, ascii_words(pattern), to)


def s(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def let(parts: dict[str, Column], body) -> Column:
    """``body`` of a row of named parts, each of which is evaluated once."""
    return F.transform(F.array(F.struct(*[c.alias(n) for n, c in parts.items()])), body)[0]


def trim(x: Column) -> Column:
    return F.regexp_replace(s(x), f"^{SPACE}+|{SPACE}+$", "")


def collapse(x: Column) -> Column:
    """White-space runs become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(s(x), f"{SPACE}+", " "))


def search_query(x: Column, limit: int = 500) -> Column:
    return F.substring(collapse(x), 1, limit)


def first_string(*xs: Column) -> Column:
    """The first argument that is not blank, trimmed; else empty."""
    return F.coalesce(*[F.nullif(trim(x), F.lit("")) for x in xs], F.lit(""))


def clip(x: Column, limit: int = 120_000, mark: str = "\n\n[Truncated]") -> Column:
    """NUL characters go; a text over the limit is cut and marked."""
    t = F.trim(F.regexp_replace(s(x), "\x00", ""))
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit(mark))).otherwise(t)


def clamp_int(x: Column, low: int, high: int, default: int) -> Column:
    """A leading integer, held within bounds; the default where there is none."""
    n = F.regexp_extract(trim(x), r"^([+-]?\d+)", 1)
    return F.when(n == "", F.lit(default)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), F.expr("1") * n.cast("double")))).cast("long")


def clamp_round(x: Column, low: int, high: int, default: int) -> Column:
    """A number rounded half up, held within bounds; the default where it is none."""
    n = F.try_cast(x, "double") if hasattr(F, "try_cast") else x.cast("string").try_cast("double")
    return F.when(n.isNull() | F.isnan(n), F.lit(default)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), F.floor(n + 0.5)))).cast("long")


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(x * F.lit(10.0**digits) + 0.5) / F.lit(10.0**digits)


def byte_size(n: Column) -> Column:
    """B below 1024, else KB or MB with one digit."""
    kb, mb = n / 1024, n / (1024 * 1024)
    return F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.format_string("%.1f KB", kb)).otherwise(F.format_string("%.1f MB", mb))


# File-name endings and their MIME types.
MIME = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "txt": "text/plain",
    "md": "text/markdown",
    "csv": "text/csv",
    "json": "application/json",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "webp": "image/webp",
    "gif": "image/gif",
}


def mime_of(name: Column) -> Column:
    end = F.lower(F.regexp_extract(s(name), r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(v) for kv in MIME.items() for v in kv])
    return F.coalesce(F.try_element_at(table, end), F.lit("application/octet-stream"))


# --- tokens -----------------------------------------------------------------------------------------

# Word lists.
STOP_FRESH = "the and for with latest recent news update updates release releases".split()
STOP_RELEVANCE = (
    "the a an and or but if then than is are was were be been being who what when where why how in on for to of with by from "
    "me you your my our their latest current today update updates"
).split()
STOP_TOPIC = (
    "a an the and or but if then than do does did can could would will should what which who whom whose when where why how is are am was were be been being "
    "have has had i me my mine you your yours we our ours they their theirs he she it this that these those there here please kindly just about on for to of in "
    "at by with from into as per tell show give find search look lookup check explain describe summarize summary latest recent current today right now update updates "
    "sources source link links news headline headlines"
).split()
COMMON_TERMS = (
    "who what when where which current latest present the of for in is are and or official source tell me about facts fact answer please"
).split()
STOP_INTENT = (
    "the a an of for about on is are was were to in and or me i you please can could should would search web find look up latest recent current newest review reviews hands "
    "on worth best vs compare comparison price available availability launched released release"
).split()



def terms(x: Column, shape: str = "[a-z0-9]+", stop: list[str] | None = None) -> Column:
    """Distinct lower-case matches of ``shape`` in order of first sight, without stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(s(x)), F.lit(f"({shape})"), 1))
    return F.filter(found, lambda t: ~t.isin(stop)) if stop else found


def query_terms(x: Column) -> Column:
    return terms(x)


def long_terms(x: Column) -> Column:
    return terms(x, "[a-z0-9]{3,}")


def fresh_terms(x: Column) -> Column:
    return terms(x, "[a-z0-9][a-z0-9.+-]+", STOP_FRESH)


def runs(x: Column, least: int = 1) -> Column:
    """All runs of lower-case letters and digits of ``least`` characters or more, in order."""
    return F.regexp_extract_all(F.lower(s(x)), F.lit(f"[a-z0-9]{{{least},}}"), 0)


def first_terms(words: Column, stop: list[str], limit: int, distinct: bool = True) -> Column:
    """Of runs of two characters or more: stop words out, the first ``limit``, then made distinct."""
    kept = F.slice(F.filter(words, lambda t: ~t.isin(stop)), 1, limit)
    return F.array_distinct(kept) if distinct else kept


def spaced_terms(x: Column, stop: list[str], limit: int, distinct: bool = True) -> Column:
    """Runs of letters and digits of two characters or more, stop words out, the first ``limit``, then made distinct."""
    return first_terms(runs(x, 2), stop, limit, distinct)


def relevance_terms(x: Column) -> Column:
    return spaced_terms(x, STOP_RELEVANCE, 16)


def topic_terms(x: Column) -> Column:
    return spaced_terms(x, STOP_TOPIC, 16)


def intent_tokens(x: Column) -> Column:
    return F.filter(runs(x, 2), lambda t: ~t.isin(STOP_INTENT))


def code_tokens(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(s(x), F.lit(r"([A-Za-z][A-Za-z0-9_.'-]*)"), 1))


WORD = "[A-Za-z0-9]+(?:['-][A-Za-z0-9]+)*"


def count_words(x: Column) -> Column:
    return F.regexp_count(s(x), F.lit(WORD))


def trim_words(x: Column, n: Column | int) -> Column:
    """The first ``n`` white-space tokens; a cut text loses trailing commas and ends in a mark."""
    n = F.lit(n) if isinstance(n, int) else n
    t = trim(x)
    tokens = F.split(t, f"{SPACE}+")
    cut = F.regexp_replace(F.array_join(F.slice(tokens, 1, F.greatest(n, F.lit(1))), " "), r"[,\s]+$", "")
    ended = F.when(cut.rlike(r"[.!?]$"), cut).otherwise(F.concat(cut, F.lit(".")))
    return F.when(n < 1, F.lit("")).when(F.size(tokens) <= n, t).otherwise(ended)


def enforce_words(x: Column, mode: Column, low: Column, high: Column, target: Column) -> Column:
    """Cuts a text that breaks its word limits; short ones stay as they are."""
    t, n = trim(x), count_words(trim(x))
    over = F.when((mode == "exact") & (target > 0) & (n > target), target).when(mode.isin("max", "range", "target") & (high > 0) & (n > high), high)
    return F.when(over.isNotNull(), trim_words(t, over)).otherwise(t)


def word_request(x: Column) -> Column:
    """struct(mode, low, high, target) of a word-count wish; null where there is none. The order is the meaning."""
    t = s(x)
    num = r"(\d{1,4})"  # every wish has a number before the words; a text without one is looked at once

    def got(p: str, g: int = 1) -> Column:
        return F.nullif(group(t, "(?i)" + p, g), F.lit("")).cast("int")

    def spec(mode: str, low: Column, high: Column, target: Column) -> Column:
        return F.struct(F.lit(mode).alias("mode"), low.cast("int").alias("low"), high.cast("int").alias("high"), target.cast("int").alias("target"))

    up = lambda c: F.floor(c + 0.5)
    one = lambda c: F.greatest(F.lit(1), c)
    pair = rf"\b{num}\s*(?:-|to)\s*{num}\s+words?\b"
    parts = {
        "a": got(pair, 1),
        "b": got(pair, 2),
        "exact": F.coalesce(got(rf"\b(?:exactly|strictly|no more no less than)\s+{num}\s+words?\b"), got(rf"\b{num}\s+words?\s+exactly\b")),
        "most": got(rf"\b(?:under|within|at most|no more than|max(?:imum)?(?: of)?)\s+{num}\s+words?\b"),
        "least": got(rf"\b(?:at least|minimum(?: of)?|no less than)\s+{num}\s+words?\b"),
        "about": got(rf"\b(?:around|about|approximately|approx(?:\.|imately)?|roughly)\s+{num}\s+words?\b"),
        "bare": F.coalesce(
            got(rf"\b(?:in|within)\s+{num}\s+words?\b"),
            got(rf"\b(?:answer|respond|explain|write|summarize|describe|give(?:\s+me)?)\b[\s\S]{{0,60}}?\b(?:in\s+)?{num}\s+words?\b"),
            got(rf"\b{num}\s+words?\b"),
        ),
    }

    def choose(r: Column) -> Column:
        low, high = one(F.least(r["a"], r["b"])), one(F.greatest(r["a"], r["b"]))
        most, least, about = r["most"], r["least"], r["about"]
        return (
            F.when(r["a"].isNotNull(), spec("range", low, high, up((low + high) / 2)))
            .when(r["exact"].isNotNull(), spec("exact", r["exact"], r["exact"], r["exact"]))
            .when(most.isNotNull(), spec("max", F.lit(0), one(most), one(up(most * 0.9))))
            .when(least.isNotNull(), spec("min", one(least), one(up(least * 1.5)), one(up(least * 1.1))))
            .when(about.isNotNull(), spec("target", one(up(about * 0.85)), one(up(about * 1.15)), one(about)))
            .when(r["bare"].isNotNull(), spec("exact", r["bare"], r["bare"], r["bare"]))
        )

    return F.when(has(t, r"(?i)\d\s+words?\b"), let(parts, choose))


# --- markup -----------------------------------------------------------------------------------------


def _subs(x: Column, *pairs: tuple[str, str]) -> Column:
    for pattern, to in pairs:
        x = F.regexp_replace(x, ascii_words(pattern), to)
    return x


def strip_tags(x: Column) -> Column:
    return _subs(s(x), (r"<[^>]*>", " "), (f"{SPACE}+", " "))


def html_title(x: Column) -> Column:
    return trim(strip_tags(F.regexp_extract(s(x), r"(?is)<title[^>]*>(.*?)</title>", 1)))


def html_description(x: Column) -> Column:
    a = F.regexp_extract(s(x), r"""(?i)<meta[^>]+name=["']description["'][^>]+content=["']([^"']+)["'][^>]*>""", 1)
    b = F.regexp_extract(s(x), r"""(?i)<meta[^>]+content=["']([^"']+)["'][^>]+name=["']description["'][^>]*>""", 1)
    return trim(strip_tags(F.when(a != "", a).otherwise(b)))


def html_strip(x: Column) -> Column:
    """All text but scripts, styles, navigation and footers."""
    return strip_tags(_subs(s(x), *[(rf"(?is)<{t}.*?</{t}>", " ") for t in ("script", "style", "nav", "footer")]))


def entities(x: Column) -> Column:
    """Named references (the ampersand first, so doubly escaped ones decode twice), then numeric ones."""
    out = _subs(s(x), ("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&quot;", '"'), ("&#39;", "'"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"))

    def numeric(t: Column, shape: str, base: int) -> Column:
        refs = F.array_distinct(F.regexp_extract_all(t, F.lit(f"(?i)({shape})"), 1))

        def one(acc: Column, ref: Column) -> Column:
            code = F.conv(F.regexp_extract(ref, "([0-9a-fA-F]+);", 1), base, 10).cast("int")
            code = F.when(code.isNull() | ~code.between(1, 0x10FFFF) | code.between(0xD800, 0xDFFF), F.lit(32)).otherwise(code)
            # a code point as UTF-32, so that every plane is reached
            return F.replace(acc, ref, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))

        return F.aggregate(refs, t, one)

    return numeric(numeric(out, r"&#\d+;", 10), r"&#x[0-9a-f]+;", 16)


NOISE_TAGS = ("script", "style", "noscript", "svg", "iframe")
FRAME_TAGS = ("nav", "footer", "header", "aside", "form", "button")
NOISE_CLASSES = "cookie|consent|banner|advert|ad-|ads|promo|subscribe|newsletter|modal|sidebar|menu|breadcrumb|social|share"


def readable_text(x: Column, limit: int = 12_000) -> Column:
    """Article, else main, else all; noise out; block ends become line feeds; references decode before tags go."""
    raw = s(x)
    article = F.regexp_extract(raw, r"(?is)<article\b[^>]*>(.*?)</article>", 1)
    main = F.regexp_extract(raw, r"(?is)<main\b[^>]*>(.*?)</main>", 1)
    body = F.when(article != "", article).when(main != "", main).otherwise(raw)
    body = _subs(body, *[(rf"(?is)<{t}\b.*?</{t}>", " ") for t in NOISE_TAGS], *[(rf"(?is)<{t}\b.*?</{t}>", " ") for t in FRAME_TAGS])
    body = F.regexp_replace(body, rf"""(?is)<[^>]+class=["'][^"']*(?:{NOISE_CLASSES})[^"']*["'][^>]*>.*?</[^>]+>""", " ")
    out = _subs(
        entities(body), (r"(?i)<br\s*/?>", "\n"), (r"(?i)</(?:p|div|section|article|li|h1|h2|h3|h4)>", "\n"), (r"<[^>]+>", " "), (r"[ \t]+", " "), (r"\n\s+", "\n"), (r"\n{3,}", "\n\n")
    )
    return F.substring(trim(out), 1, limit)


def xml_entities(x: Column) -> Column:
    return _subs(s(x), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def feed_text(x: Column) -> Column:
    """CDATA unwrapped, references decoded, white space collapsed."""
    out = _subs(
        s(x), (r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), ("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&quot;", '"'), ("&#39;", "'"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">")
    )
    return collapse(out)


def first_tag(x: Column, tag: str) -> Column:
    return F.regexp_extract(s(x), rf"(?is)<(?:[a-z]+:)?{tag}\b[^>]*>(.*?)</(?:[a-z]+:)?{tag}>", 1)


def blocks(x: Column, tag: str) -> Column:
    return F.regexp_extract_all(s(x), F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), 1)


def strip_markdown(x: Column) -> Column:
    out = _subs(s(x), (r"(?s)```.*?```", " "), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"[#*_`>~]+", " "))
    return collapse(out)


# --- small normalisers ------------------------------------------------------------------------------


def dashes(x: Column) -> Column:
    """Long dashes and hyphens, no-break spaces and curly quotes become plain ones."""
    return F.translate(s(x), "\u2010\u2011\u2012\u2013\u2014\u2015\u00a0\u202f\u2018\u2019\u201c\u201d", "------  ''\"\"")


def redact(x: Column, limit: int = 220) -> Column:
    """Runs of 24 or more token characters are hidden."""
    return F.substring(F.trim(_subs(s(x), (f"{SPACE}+", " "), ("[A-Za-z0-9_-]{24,}", "[redacted]"))), 1, limit)


def useful_text(x: Column) -> Column:
    t = collapse(x)
    return (F.length(t) >= 40) & (F.regexp_count(t, F.lit("[A-Za-zÀ-ɏ]")) >= 24)


def fillers(x: Column) -> Column:
    return F.trim(_subs(s(x), (r"(?i)\b(?:um+|uh+|er+|ah+|erm+)\b", ""), (r"\s{2,}", " ")))


def script_language(x: Column) -> Column:
    """Locale by script range; null where none of them occurs."""
    t = s(x)
    return F.when(t.rlike("[஀-௿]"), "ta-IN").when(t.rlike("[ఀ-౿]"), "te-IN").when(t.rlike("[ಀ-೿]"), "kn-IN").when(t.rlike("[ऀ-ॿ]"), "hi-IN")


def locale(x: Column) -> Column:
    v = trim(x)
    low = F.lower(v)
    out = F.when(v.isin("en-US", "en-IN", "ta-IN", "te-IN", "kn-IN", "hi-IN"), v)
    for code in ("ta", "te", "kn", "hi"):
        out = out.when(low.startswith(code), f"{code}-IN")
    return out.otherwise("en-US")


def confidence_bucket(x: Column, uncertainty: Column | None = None) -> Column:
    """high, medium, low; medium wherever an uncertainty is told, empty without a number."""
    told = F.lit(False) if uncertainty is None else s(uncertainty) != ""
    return F.when(told, "medium").when(x.isNull() | F.isnan(x), "").otherwise(_bucket(x))


def _bucket(x: Column) -> Column:
    return F.when(x >= 0.82, "high").when(x >= 0.55, "medium").otherwise("low")


def json_object(x: Column) -> Column:
    """The JSON text of an object: the whole text without code fences, else its outermost braces; null if neither parses."""
    raw = F.trim(_subs(trim(x), (r"(?i)^```(?:json)?\s*", ""), (r"```$", "")))
    inner = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.to_json(F.try_parse_json(raw)), F.to_json(F.try_parse_json(F.nullif(inner, F.lit("")))))


def think_parts(x: Column) -> Column:
    """struct(thought, response) of a text with a closed or unclosed think block."""
    t = trim(x)
    closed = F.regexp_extract(t, r"(?is)<think>(.*?)</think>", 1)
    opened = F.regexp_extract(t, r"(?is)<think>(.*)$", 1)
    has = t.rlike(r"(?is)<think>.*?</think>")
    return F.when(has, F.struct(F.trim(closed).alias("thought"), trim(F.regexp_replace(t, r"(?is)<think>.*?</think>", "")).alias("response"))).otherwise(
        F.struct(F.trim(opened).alias("thought"), trim(F.regexp_replace(t, r"(?is)<think>.*$", "")).alias("response"))
    )
