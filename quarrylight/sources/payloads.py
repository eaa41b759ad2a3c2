"""Provider payloads landed as JSON texts, normalised to one shape of source row. Nothing here calls a network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.dates import gdelt_date
from ..functions.text import collapse, group, s, strip_tags

#: provider -> (schema of the JSON, path of its rows, title, url, description, date, kind, label)
SHAPES: dict[str, tuple[str, str, str, str, str, str, str, str]] = {
    "wikipedia": ("query struct<search: array<struct<title: string, snippet: string, timestamp: string>>>", "query.search", "r.title", "concat('https://en.wikipedia.org/wiki/', replace(r.title, ' ', '_'))", "r.snippet", "r.timestamp", "encyclopedia", "Wikipedia"),
    "gdelt": ("articles array<struct<title: string, url: string, domain: string, seendate: string>>", "articles", "r.title", "r.url", "concat('Source: ', r.domain)", "r.seendate", "public_news", "GDELT"),
    "wikidata": ("search array<struct<id: string, label: string, description: string>>", "search", "r.label", "concat('https://www.wikidata.org/wiki/', r.id)", "r.description", "''", "structured_reference", "Wikidata"),
    "reddit": ("data struct<children: array<struct<data: struct<title: string, permalink: string, selftext: string>>>>", "data.children", "r.data.title", "concat('https://www.reddit.com', r.data.permalink)", "r.data.selftext", "''", "community_discussion", "Reddit"),
    "serper": ("organic array<struct<title: string, link: string, snippet: string, date: string>>", "organic", "r.title", "r.link", "r.snippet", "r.date", "public_news", "Search"),
    "serper_news": ("news array<struct<title: string, link: string, snippet: string, date: string>>", "news", "r.title", "r.link", "r.snippet", "r.date", "trusted_news", "Search news"),
    "exa": ("results array<struct<title: string, url: string, text: string, publishedDate: string>>", "results", "r.title", "r.url", "r.text", "r.publishedDate", "exa_search", "Exa"),
    "searxng": ("results array<struct<title: string, url: string, content: string, engine: string>>", "results", "r.title", "r.url", "r.content", "''", "free_web", "SearXNG"),
    # landed answers of public services; a path of '' is the answer itself as one row
    "weather": ("place struct<name: string, admin1: string, country: string>, current struct<temperature_2m: double, apparent_temperature: double, relative_humidity_2m: double, wind_speed_10m: double>, current_units struct<temperature_2m: string, apparent_temperature: string, relative_humidity_2m: string, wind_speed_10m: string>", "", "concat('Current weather for ', concat_ws(', ', nullif(r.place.name, ''), nullif(r.place.admin1, ''), nullif(r.place.country, '')))", "'https://open-meteo.com/'", "concat_ws(' | ', concat('Temperature: ', r.current.temperature_2m, coalesce(r.current_units.temperature_2m, 'C')), concat('Feels like: ', r.current.apparent_temperature, coalesce(r.current_units.apparent_temperature, 'C')), concat('Humidity: ', r.current.relative_humidity_2m, coalesce(r.current_units.relative_humidity_2m, '%')), concat('Wind: ', r.current.wind_speed_10m, ' ', coalesce(r.current_units.wind_speed_10m, 'km/h')))", "''", "free_weather", "Open-Meteo"),
    "crypto": ("id string, usd double, inr double, usd_24h_change double", "", "concat(initcap(r.id), ' public price')", "'https://www.coingecko.com/'", "concat_ws(' | ', concat('USD ', r.usd), concat('INR ', r.inr), concat('24h USD change ', format_number(r.usd_24h_change, '0.00'), '%'))", "''", "free_crypto_price", "CoinGecko"),
    "disasters": ("events array<struct<title: string, categories: array<struct<title: string>>, sources: array<struct<url: string>>, geometry: array<struct<date: string>>>>", "events", "coalesce(nullif(r.title, ''), 'Natural event')", "coalesce(get(r.sources, 0).url, 'https://eonet.gsfc.nasa.gov/')", "array_join(transform(r.categories, c -> c.title), ', ')", "get(r.geometry, 0).date", "free_disaster_event", "NASA EONET"),
    "sports": ("teams array<struct<strTeam: string, strAlternate: string, strLeague: string, strDescriptionEN: string, strWebsite: string>>", "teams", "coalesce(nullif(r.strTeam, ''), nullif(r.strAlternate, ''), 'Sports team')", "coalesce(concat('https://', regexp_replace(nullif(r.strWebsite, ''), '^https?://', '')), 'https://www.thesportsdb.com/')", "coalesce(nullif(r.strDescriptionEN, ''), nullif(r.strLeague, ''))", "''", "free_sports_reference", "TheSportsDB"),
    "places": ("places array<struct<name: string, display_name: string, osm_id: bigint>>", "places", "coalesce(nullif(r.name, ''), r.display_name)", "concat('https://www.openstreetmap.org/node/', r.osm_id)", "r.display_name", "''", "free_place_data", "OpenStreetMap"),
    "summary": ("title string, extract string, content_urls struct<desktop: struct<page: string>>", "", "r.title", "coalesce(nullif(r.content_urls.desktop.page, ''), concat('https://en.wikipedia.org/wiki/', replace(r.title, ' ', '_')))", "r.extract", "''", "encyclopedia", "Wikipedia"),
    "instant": ("Heading string, AbstractText string, AbstractURL string", "", "r.Heading", "r.AbstractURL", "r.AbstractText", "''", "free_reference", "DuckDuckGo"),
    "extract": ("result struct<title: string, markdown: string, text: string, url: string, description: string, metadata: struct<title: string, description: string>>", "", "coalesce(nullif(r.result.title, ''), nullif(r.result.metadata.title, ''), r.result.url)", "r.result.url", "coalesce(nullif(r.result.description, ''), nullif(r.result.metadata.description, ''), regexp_replace(coalesce(nullif(r.result.text, ''), r.result.markdown), '[#*_`>~]+', ' '))", "''", "page_extract", "Page extraction"),
}


def normalise(payloads: DataFrame, provider: str, text: str = "payload") -> DataFrame:
    """query, position, title, url, domain, description, date, kind, label, trusted for one provider's payloads (columns query and payload)."""
    schema, path, title, url, description, date, kind, label = SHAPES[provider]
    read = payloads.select("query", F.from_json(F.col(text), schema).alias("j"))
    rows = read.select("query", F.posexplode(F.col(f"j.{path}") if path else F.array("j")).alias("at", "r"))
    u = urls.candidate(F.expr(url))
    out = rows.select(
        "query", (F.col("at") + 1).alias("position"), collapse(F.expr(title)).alias("title"), u.alias("url"), urls.host(u).alias("domain"),
        F.substring(collapse(strip_tags(F.expr(description))), 1, 500).alias("description"), gdelt_date(s(F.expr(date))).alias("date"), F.lit(kind).alias("kind"), F.lit(label).alias("label"),
        urls.is_trusted_host(urls.host(u)).alias("trusted"),
    )
    return out.filter("title <> '' AND url <> ''")


def claims(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """query, holder, office, start, end, url from SPARQL bindings."""
    v = "struct<value: string>"
    schema = f"results struct<bindings: array<struct<holder: {v}, holderLabel: {v}, officeLabel: {v}, start: {v}, `end`: {v}, article: {v}>>>"
    rows = payloads.select("query", F.from_json(F.col(text), schema).alias("j")).select("query", F.posexplode("j.results.bindings").alias("at", "b"))
    day = lambda c: group(s(F.col(c)), r"^(\d{4}-\d{2}-\d{2})")
    entity = group(s(F.col("b.holder.value")), r"\b(Q\d+)\b")
    return rows.select(
        "query", "at", F.trim(s(F.col("b.holderLabel.value"))).alias("holder"), F.trim(s(F.col("b.officeLabel.value"))).alias("office"), day("b.start.value").alias("start"), day("b.end.value").alias("end"),
        F.when(entity != "", F.concat(F.lit("https://www.wikidata.org/wiki/"), entity)).otherwise(s(F.col("b.holder.value"))).alias("url"),
    )


def search_page(html: Column) -> Column:
    """array(struct(title, url, snippet)) of a result page; redirect links are unwrapped."""
    parts = F.slice(F.split(html, r"""class=["'][^"']*result__a"""), 2, 1000)

    def one(p: Column) -> Column:
        href = group(p, r"""href=["']([^"']+)["']""")
        inner = group(href, r"[?&]uddg=([^&]+)")
        return F.struct(
            collapse(strip_tags(group(p, r"(?s)^[^>]*>(.*?)</a>"))).alias("title"),
            F.when(inner != "", F.try_url_decode(inner)).otherwise(href).alias("url"),
            collapse(strip_tags(group(p, r"""(?s)class=["'][^"']*result__snippet[^>]*>(.*?)</a>"""))).alias("snippet"),
        )

    return F.transform(parts, one)


def reference_links(queries: DataFrame, query: str = "query") -> DataFrame:
    """query, title, url: two lookup links per query."""
    q = F.col(query)
    links = F.array(
        F.struct(F.concat(F.lit("Encyclopedia lookup: "), q).alias("title"), F.concat(F.lit("https://en.wikipedia.org/wiki/Special:Search?search="), F.url_encode(q)).alias("url")),
        F.struct(F.concat(F.lit("Archive lookup: "), q).alias("title"), F.concat(F.lit("https://archive.org/search?query="), F.url_encode(q)).alias("url")),
    )
    return queries.select(query, F.explode(links).alias("l")).select(query, "l.title", "l.url")


def sse_events(text: Column) -> Column:
    """Payloads of a captured event stream: frames end at a blank line, data lines join, the end mark goes."""
    frames = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n\n+")
    data = F.transform(frames, lambda f: F.array_join(F.transform(F.filter(F.split(f, "\n"), lambda x: x.startswith("data:")), lambda x: F.trim(F.substr(x, F.lit(6)))), "\n"))
    return F.filter(data, lambda d: (d != "") & (d != "[DONE]"))
