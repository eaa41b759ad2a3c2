"""Records of searches in their common shapes: source rows with defaults, feed rows, official sources, first matches of ordered candidates, landed calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import policy, queries, urls
from ..functions.text import collapse, s, trim
from ..sources.feeds import parse_time

# --- shapes ----------------------------------------------------------------------------------------------------------------


def source_row(item: dict[str, Column], position: Column | None = None) -> dict[str, Column]:
    """The columns of a source row from whichever of its parts are there; blank texts and defaults for the rest."""
    text = lambda name, default="": F.coalesce(F.nullif(trim(item[name]), F.lit("")), F.lit(default)) if name in item else F.lit(default)
    no_signals = F.array(F.lit("free_public_source"))
    out = {n: text(n) for n in ("title", "description", "url", "source", "date", "query")}
    out |= {"domain": urls.host(out["url"]), "kind": text("kind", "free_public_source"), "label": out["source"], "freshness": text("freshness", "unknown")}
    out["position"] = F.coalesce(F.nullif(position.cast("int"), F.lit(0)), F.lit(1)) if position is not None else F.lit(1)
    out["trusted"] = F.coalesce(item["trusted"], F.lit(False)) if "trusted" in item else F.lit(False)
    out["signals"] = F.coalesce(item["signals"], no_signals) if "signals" in item else no_signals
    return out


def feed_row(item: dict[str, Column], fetched_at: Column) -> dict[str, Column]:
    """A feed's item as it is cached: the address without its fragment, white space collapsed, times read; its address is its id where it has none."""
    either = lambda *names: F.coalesce(*[F.nullif(collapse(item[n]), F.lit("")) for n in names if n in item], F.lit(""))
    url = urls.normalize(either("url", "link"))
    when = lambda *names: parse_time(either(*names))
    return {
        "id": F.coalesce(F.nullif(either("id"), F.lit("")), url), "title": either("title"), "url": url, "summary": either("summary", "description"), "source": either("source", "source_name"), "source_id": either("source_id"),
        "published_at": when("published_at", "date"), "fetched_at": F.coalesce(when("fetched_at"), fetched_at),
    }


def cached_row(feed: dict[str, Column]) -> dict[str, Column]:
    """A cached feed item as a source row: labelled by its source, else its host; recent if it has a time."""
    host = urls.host(feed["url"])
    label = F.coalesce(F.nullif(trim(feed["source"]), F.lit("")), F.nullif(host, F.lit("")), F.lit("Latest cache"))
    recent = F.when(feed["published_at"].isNotNull(), "cached_recent").otherwise("cached")
    return source_row({"title": feed["title"], "url": feed["url"], "description": feed["summary"], "source": label, "freshness": recent})


def official_row(label: Column, url: Column, page_title: Column, page_description: Column, page_text: Column, fetched: Column, role: str, jurisdiction: str, signal: Column | None = None, registered: Column | None = None) -> dict[str, Column]:
    """A portal as a source with its level of evidence: it names the holder of the office asked for, its page was read, or it is a link.

    ``page_*`` are null where nothing was fetched; ``signal`` says how the portal was found, ``registered`` whether it is a listed one.
    """
    got = F.coalesce(fetched, F.lit(False))
    holder = F.when(got, queries.holder(s(page_text), role, jurisdiction))
    held = F.coalesce(holder, F.lit("")) != ""
    signals = F.filter(
        F.array(F.lit("official_source"), F.lit("trusted_domain"), F.when(got, "page_fetched").otherwise("page_not_fetched"), s(signal) if signal is not None else F.lit(""), F.when(held, "current_office_claim").otherwise("")), lambda x: x != ""
    )
    plain = F.concat(F.lit("Official source for "), F.regexp_replace(s(label), r"(?i)\s+official$", ""), F.lit(" updates and primary information."))
    first = lambda x, default: F.coalesce(F.nullif(s(x), F.lit("")), default)
    return {
        "title": first(page_title, s(label)), "description": first(page_description, plain), "url": s(url), "domain": urls.host(url), "source": s(label), "kind": F.lit("official_source"),
        "freshness": F.when(got, "official_page_fetched").otherwise("official_homepage_unverified"), "trusted": F.lit(True), "fetched": got,
        "level": F.when(held, "official_current_holder").when(got, "official_page").otherwise("unverified_link"), "signals": signals,
        "confidence": queries.portal_confidence(url, registered if registered is not None else F.lit(False)), "holder": F.coalesce(holder, F.lit("")), "role": F.when(held, role).otherwise(""), "jurisdiction": F.when(held, jurisdiction).otherwise(""),
    }


# --- lookups ---------------------------------------------------------------------------------------------------------------


def office_titles(role: Column, jurisdiction: Column) -> Column:
    """Titles under which an encyclopedia may tell of an office, the likeliest first."""
    low = F.lower(role)
    return F.array_distinct(F.array(F.concat(F.lit("List of "), low, F.lit("s of "), jurisdiction), F.concat(F.lit("List of "), role, F.lit("s of "), jurisdiction), F.concat(role, F.lit(" of "), jurisdiction), F.concat(F.lit("Government of "), jurisdiction)))


def first_found(asked: DataFrame, articles: DataFrame, key: str, candidates: str, title: str = "title", text: str = "extract", order: str = "ord") -> DataFrame:
    """key, candidate, and the columns of ``articles``: of each row's ordered ``candidates`` (an array) the first one that an article with a text has as its title.

    Of articles with one title the first by ``order`` is taken. All candidates are looked up in one join; a title that a third of all rows ask for
    is one row on the article's side. Rows without a match are left out.
    """
    tries = asked.select(key, F.posexplode(candidates).alias("_at", "candidate")).filter("candidate <> ''")
    known = articles.filter(trim(F.col(text)) != "").withColumn("_title", F.col(title))
    firsts = known.groupBy("_title").agg(F.min(order).alias("_first"))
    one = known.join(firsts, "_title").filter(F.col(order) == F.col("_first")).drop("_first")
    hit = tries.join(one.select("_title"), tries.candidate == F.col("_title"), "left_semi")
    best = hit.groupBy(key).agg(F.min_by("candidate", "_at").alias("candidate"))
    return best.join(one, best.candidate == one["_title"]).drop("_title")


def fulfilled(calls: DataFrame, outcomes: DataFrame, order: list[str], rows: str = "rows") -> DataFrame:
    """query, position and the fields of each row: the rows of the calls (query, provider and their order) that were fulfilled, in order; calls that failed, or never ended, have none.

    ``outcomes`` has query, provider, status and an array of row structs. Positions run over each query.
    """
    ok = outcomes.filter("status = 'fulfilled'").select("query", "provider", F.col(rows).alias("_rows"))
    each = calls.join(ok, ["query", "provider"]).select("query", *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.posexplode("_rows").alias("_at", "r"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(*[f"_o{i}" for i in range(len(order))], "_at"))
    return each.withColumn("position", place).select("query", "position", "r.*")


# --- filters of landed answers ------------------------------------------------------------------------------------------------


def matching_events(events: DataFrame, terms: Column, *texts: Column, by: str, most: int = 8) -> DataFrame:
    """Events of which any of the texts holds any term (no terms ask for nothing), the first ``most`` of a group by ``ord``, numbered anew."""
    hay = F.concat_ws(" ", *[s(t) for t in texts])
    place = F.row_number().over(Window.partitionBy(by).orderBy("ord"))
    return events.filter(policy.holds_any(hay, terms)).withColumn("position", place).filter(F.col("position") <= most)


def matching_places(places: DataFrame, query: Column, by: str, most: int = 8) -> DataFrame:
    """Places (title, description, ord) that are what the query asks for, the first ``most`` of a group, numbered anew."""
    place = F.row_number().over(Window.partitionBy(by).orderBy("ord"))
    return places.filter(policy.is_relevant_place(query, F.col("title"), F.col("description"))).withColumn("position", place).filter(F.col("position") <= most)


# --- memory -----------------------------------------------------------------------------------------------------------------


def session_memory(turns: DataFrame, attachments: DataFrame, query: str, most: int = 4, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """key, place, source, snippet: the first turns of each conversation, then its attachments (key, ord, name, text), that hold any query word of three letters or more."""
    words = [t for t in query.lower().split() if len(t) >= 3]

    def cut(text: Column, n: int) -> Column:
        return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)

    number = F.row_number().over(Window.partitionBy(key).orderBy(order))
    said = turns.select(key, F.lit(0).alias("_part"), number.cast("long").alias("_o"), F.concat(F.lit("turn_"), number, F.lit("_"), F.coalesce(F.nullif(s(F.col("role")), F.lit("")), F.lit("unknown"))).alias("source"), s(F.col("text")).alias("_t"), F.lit(300).alias("_n"))
    held = attachments.select(key, F.lit(1).alias("_part"), F.col("ord").cast("long").alias("_o"), F.concat(F.lit("attachment_"), F.coalesce(F.nullif(s(F.col("name")), F.lit("")), F.lit("document"))).alias("source"), s(F.col("text")).alias("_t"), F.lit(400).alias("_n"))
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(F.lower("_t"), F.lit(w))
    rows = said.unionByName(held).filter(hit)
    place = F.row_number().over(Window.partitionBy(key).orderBy("_part", "_o"))
    snippet = F.when(F.col("_part") == 0, cut(F.col("_t"), 300)).otherwise(cut(F.col("_t"), 400))
    return rows.withColumn("place", place).filter(F.col("place") <= most).select(key, "place", "source", snippet.alias("snippet"))


