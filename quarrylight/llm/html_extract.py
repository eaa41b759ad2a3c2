r"""Main text of HTML pages by nearest-URL page differencing.

1. A tolerant tokenizer turns a page into text *lines*: one per block, references decoded, white space
   inside a block one space, with marks: does the line stand in an article or main container, does it
   stand in a region that is never article by its element or role (navigation, header, footer, aside, forms, menus),
   is it the title (h1) of a container, and which boxes around it *hint*, by class or id, at advert, notice,
   comments and the like. Scripts, styles and the like yield nothing. Hints decide by place, never by size: the main place of a page is its
   containers, or the whole page where there are none, and lines in a hinting box go unless the box is around the least hinted lines of the main
   place, too. So comments and adverts go however long they are, and a box that wraps the whole article takes nothing.
2. Differencing: pages of a host are ordered by URL path (then whole URL, then id, then content). Pages of equal content in a row are one run, so that
   any number of copies is looked past. The nearest run of its host in that order, the next one first, that is no copy of the page
   (``is_copy``: nearly all words in common, which tells nothing about templates) is its neighbour; edited copies are looked past for
   ``REACH`` runs. The lines of the two are aligned by longest common subsequence.
3. Lines outside containers that are shared with the neighbour are template text and go. Inside a container equal paragraphs also recur by chance, so
   a line goes only if the ``SUPPORT`` nearest different pages all share it, at the same place counted from the container's start or end. A
   container's title stays. All else is kept, in page order.

Skew: a third of all pages may lie on one host. Pages are put in (host, path) order over blocks whose borders come from
a sample of the keys, so a large host spans many blocks. One page of each of the ``REACH`` runs at either end of a block is known to
the driver (a few keys for a block, however many pages and copies), and these pages also go to the blocks beside it. So a page's text
depends neither on the borders nor on the number of partitions. A block is read in one pass that holds a few runs: one page of each, and
the ids and urls of the others.

Defined cases: null html is empty text; null or unparsable url has an empty host and path; rows that
repeat a page_id are pages of their own; a page alone on its host is compared with none; an empty table
gives an empty result.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape
from itertools import islice
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage, text_of, unstage

# Element names of HTML by how they break text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
SKIP = frozenset("script style noscript template iframe object embed svg math canvas audio video head title select textarea".split())
RAW = frozenset("script style textarea title noscript iframe".split())
NEVER = frozenset("nav header footer aside form menu dialog button fieldset".split())
CONTAINER = frozenset("article main".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert".split())
NEVER_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-bar|footer|header|masthead|cookies?|consent|gdpr|notice|alert|"
    r"popup|modal|newsletter|subscribe|signup|login|social|share|sharing|related|recommended|comments?|commentlist|disqus|respond|replies|reply|widget|toolbar|pagination|pager|skip-link)(?:$|[\s_-]|\d)",
    re.I,
)

#: Boxes whose class or id may hint; text elements (p, h1, li, td) keep their words whatever they are called.
BOXES = frozenset("div section span ul ol dl table figure details center".split())
REACH = 6
SUPPORT = 6
#: Keys sampled for a block, and blocks for a partition: they balance the blocks, and decide nothing else.
SAMPLED, BLOCKS = 16, 4

#: From this share of common words on, two pages are copies. Neighbours of check_s and sf0.1 share at most 0.4 or at least 0.9.
COPY = 0.8

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACES = re.compile(r"\s+")


class Line(NamedTuple):
    text: str
    inside: bool  # of a container
    never: bool
    title: bool
    hint: frozenset[int]  # the boxes around it whose class or id hints


def lines_of(html: str) -> list[Line]:
    """Each block of text, in page order."""
    out: list[Line] = []
    buf: list[str] = []
    stack: list[tuple[str, bool, bool, bool, frozenset[int]]] = []  # name, skipped, in container, never, hinting boxes

    def state() -> tuple[bool, bool, bool, frozenset[int]]:
        return stack[-1][1:] if stack else (False, False, False, frozenset())

    def flush() -> None:
        if buf:
            text = _SPACES.sub(" ", "".join(buf)).strip()
            buf.clear()
            if text:
                _, inside, never, hint = state()
                out.append(Line(text, inside, never, inside and any(x[0] == "h1" for x in stack), hint))

    def close(name: str) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                if name not in INLINE or stack[i][1] or stack[i][3:] != (stack[i - 1][3:] if i else (False, frozenset())):
                    flush()
                del stack[i:]
                return

    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            if not state()[0]:
                buf.append(unescape(html[at:lt]))
            at = lt
            continue
        m = _TOKEN.match(html, at)
        if m is None:  # a bare "<"
            if not state()[0]:
                buf.append("<")
            at += 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "p" and not any(x[0] == "p" for x in stack):
                flush()
            close(name)
            if name in CLOSES_P or name in ("li", "td", "th", "tr", "dt", "dd"):
                flush()
            continue
        if name == "br":
            if not state()[0]:
                buf.append(" ")
            continue
        if name in CLOSES_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    flush()
                    # formatting left open by the paragraph stays open but starts no region of its own
                    del stack[i:]
                    break
                if stack[i][0] not in INLINE:
                    break
        if name in ("li", "dt", "dd", "td", "th", "tr", "option"):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name or {stack[i][0], name} == {"dt", "dd"} or {stack[i][0], name} == {"td", "th"}:
                    flush()
                    del stack[i:]
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table"):
                    break
        if name not in INLINE:
            flush()
        if name in VOID:
            continue
        skip, inside, never, hint = state()
        attrs = {k.lower(): a or b or c or "" for k, a, b, c in _ATTR.findall(m[3])} if "=" in m[3] else {}
        own = name in NEVER or attrs.get("role", "").lower() in NEVER_ROLES
        if name == "header" and inside and not never:
            own = False  # an article's own heading block
        marked = name in BOXES and bool(NEVER_NAMES.search(f"{attrs.get('class', '')} {attrs.get('id', '')}"))
        hidden = bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", m[3])) or "display:none" in attrs.get("style", "").replace(" ", "").lower() or attrs.get("aria-hidden") == "true"
        if (own or marked) and name in INLINE:
            flush()
        stack.append((name, skip or name in SKIP or hidden, inside or name in CONTAINER or attrs.get("role") in ("main", "article"), never or own, hint | {at} if marked else hint))
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            body, at = html[at : end.start() if end else n], end.end() if end else n
            stack.pop()
            del body
    flush()
    return out


def lcs_shared(a: list, b: list) -> set[int]:
    """Indices of ``a`` on one longest common subsequence with ``b``.

    Bit-parallel rows: bit i of row j is 0 where line i adds to the common length once j lines of ``b`` are seen.
    """
    at: dict[object, int] = {}
    for i, v in enumerate(a):
        at[v] = at.get(v, 0) | 1 << i
    b = [v for v in b if v in at]
    full = (1 << len(a)) - 1
    row, rows = full, []
    for v in b:
        hit = row & at[v]
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    out, i, j = set(), len(a), len(b)
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
        elif j > 1 and not rows[j - 2] >> (i - 1) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.add(i)
    return out


def open_lines(lines: list[Line]) -> list[Line]:
    """Lines outside never-article regions, under no hinting box but those around the least hinted lines of the main place."""
    free = [x for x in lines if not x.never]
    main = [x.hint for x in free if x.inside] or [x.hint for x in free]
    least = min(map(len, main), default=0)
    around = frozenset().union(*(h for h in main if len(h) == least))
    return [x for x in free if x.hint <= around]


def words_of(lines: list[Line]) -> Counter:
    return Counter(w for x in lines for w in x.text.split())


def is_copy(a: Counter, b: Counter) -> bool:
    """Do two pages have at least COPY of the words of the longer one in common?"""
    return (a & b).total() >= COPY * max(a.total(), b.total())


class Page:
    """The open lines of a page, and where its container lines stand, counted from the container text's start and end."""

    def __init__(self, html: str):
        self.lines = open_lines(lines_of(html))
        self.words = words_of(self.lines)
        self.marks = [x[:2] for x in self.lines]
        inside = [i for i, x in enumerate(self.lines) if x.inside]
        self.places = {i: {(self.lines[i].text, n), (self.lines[i].text, n - len(inside))} for n, i in enumerate(inside)}
        self.edges = set().union(*self.places.values()) if self.places else set()


def difference(page: Page, others: Iterator[Page]) -> str:
    """The main text of a page, given the nearest pages that are no copies of it, nearest first; of these only as many are looked at as decide something."""
    gone: set[int] = set()
    first = next(others, None)
    if first is not None:
        shared = lcs_shared(page.marks, first.marks)
        gone = {i for i in shared if not page.lines[i].inside}
        held = {i for i in shared if page.lines[i].inside and not page.lines[i].title and page.places[i] & first.edges}
        for _ in range(SUPPORT - 1):
            other = next(others, None) if held else None
            if other is None:
                held = set()
                break
            held = {i for i in held if page.places[i] & other.edges}
            held = held and held & lcs_shared(page.marks, other.marks)
        gone |= held
    return "\n\n".join(x.text for i, x in enumerate(page.lines) if i not in gone)


def text_at(pages: list[Page], at: int) -> str:
    """The main text of one of a host's pages, which stand in order, one of each run."""
    page = pages[at]
    near = (pages[i] for gap in range(1, REACH + 1) for i in (at + gap, at - gap) if 0 <= i < len(pages))
    return difference(page, (other for other in near if not is_copy(page.words, other.words)))


class Run(NamedTuple):
    content: int
    page: Page
    rows: list[tuple]  # id and url of the pages of the run that belong to the block


KEY = ["host", "path", "link", "order", "content"]


def _sample(keys: DataFrame, n: int) -> list[tuple]:
    """``n`` keys, those of least hash, in order."""
    return sorted(tuple(r[k] for k in KEY) for r in keys.orderBy(F.xxhash64(*KEY)).limit(n).collect())


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row per page."""
    link = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    bare = F.regexp_replace(link, r"[?#].*$", "")
    src = pages.select(
        F.lower(F.regexp_extract(bare, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/]*)", 1)).alias("host"),
        F.regexp_replace(F.regexp_replace(bare, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", ""), "/$", "").alias("path"),
        link.alias("link"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("order"),
        F.xxhash64(text_of(html_col)).alias("content"),
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        text_of(html_col).alias("html"),
    )
    spark = pages.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = stage(src.select(*KEY), "keys")
    borders = _sample(keys, n * BLOCKS * SAMPLED)[SAMPLED::SAMPLED]

    def block_of(cut: list[tuple]) -> Callable:
        @F.pandas_udf("int")
        def block(*columns: pd.Series) -> pd.Series:
            return pd.Series([bisect.bisect_right(cut, k) for k in zip(*columns, strict=True)], dtype="int32")

        return block

    thin = keys.withColumn("block", block_of(borders)(*KEY))
    up, down = (Window.partitionBy("block").orderBy(*(getattr(F.col(k), d)() for k in KEY)) for d in ("asc", "desc"))
    start = F.coalesce((F.lag("content").over(up) != F.col("content")) | (F.lag("host").over(up) != F.col("host")), F.lit(True))
    runs = thin.withColumn("start", start).filter("start")
    ends = runs.withColumns({"a": F.row_number().over(up), "z": F.row_number().over(down)}).filter((F.col("a") <= REACH) | (F.col("z") <= REACH))
    # at most 2 * REACH rows a block
    edges = sorted((*(r[k] for k in KEY), r["block"]) for r in ends.select(*KEY, "block").collect())
    unstage(keys)
    also: dict[tuple, list[int]] = {}  # blocks beside its own that a page goes to
    for i, (*key, block) in enumerate(edges):
        beside = set()
        for step in (-1, 1):
            runs_between, j, content = 0, i + step, key[-1]
            # a block may hold fewer runs than REACH, or part of one, so look on until so many lie between
            while 0 <= j < len(edges) and edges[j][0] == key[0]:
                runs_between += edges[j][-2] != content
                content = edges[j][-2]
                if runs_between > REACH:
                    break
                if edges[j][-1] != block:
                    beside.add(edges[j][-1])
                j += step
        also.setdefault(tuple(key), []).extend(sorted(beside))
    shared = spark.sparkContext.broadcast((borders, {k: v for k, v in also.items() if v}))

    @F.pandas_udf("array<int>")
    def blocks(*columns: pd.Series) -> pd.Series:
        cut, more = shared.value
        return pd.Series([[bisect.bisect_right(cut, k), *more.get(k, ())] for k in zip(*columns, strict=True)])

    dealt = src.withColumn("blocks", blocks(*KEY)).select("*", F.posexplode("blocks").alias("guest", "block")).drop("blocks")
    dealt = dealt.repartition(n * BLOCKS, "block").sortWithinPartitions("block", *KEY)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[Run] = []  # of one block and host, in order
        done, of = 0, None

        def texts(last: bool) -> Iterator[tuple]:
            """Rows of the runs that have ``REACH`` more after them; the last one held may go on."""
            nonlocal done
            while done < len(held) - (0 if last else REACH + 1):
                lo = max(0, done - REACH)
                if held[done].rows:
                    text = text_at([x.page for x in held[lo : done + REACH + 1]], done - lo)
                    yield from ((*row, text, len(text)) for row in held[done].rows)
                held[done].rows.clear()
                done += 1
            if done > REACH:
                del held[: done - REACH]
                done = REACH

        def rows() -> Iterator[tuple]:
            nonlocal done, of
            for pdf in batches:
                for page_id, url, html, content, guest, *group in zip(*(pdf[c] for c in ("page_id", "url", "html", "content", "guest", "block", "host")), strict=True):
                    if group != of:
                        yield from texts(last=True)
                        held.clear()
                        done, of = 0, group
                    if not held or held[-1].content != content:
                        held.append(Run(content, Page(html), []))
                        yield from texts(last=False)
                    if guest == 0:
                        held[-1].rows.append((None if pd.isna(page_id) else int(page_id), url))
            yield from texts(last=True)

        # frames of some hundred rows, whether they come from many pages or from one long run of copies
        found = rows()
        while some := list(islice(found, 500)):
            yield pd.DataFrame(some, columns=["page_id", "url", "text", "n_chars"]).astype({"page_id": "Int64"})

    return dealt.select("page_id", "url", "html", "content", "guest", "block", "host").mapInPandas(run, "page_id long, url string, text string, n_chars long")
