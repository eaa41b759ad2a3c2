"""URL and host functions for http(s) URLs in ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import s, trim

URL = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"

# Host lists.
TRUSTED_HOSTS = (
    "apnews.com bbc.com bbc.co.uk reuters.com thehindu.com indianexpress.com nytimes.com washingtonpost.com who.int nih.gov cdc.gov noaa.gov nasa.gov isro.gov.in rbi.org.in sec.gov "
    "imf.org worldbank.org europa.eu gov.uk usa.gov wikipedia.org wikidata.org britannica.com reddit.com archive.today archive.ph archive.is"
).split()
TRUSTED_DOMAINS = (
    "wikipedia.org en.wikipedia.org reuters.com apnews.com bbc.com bbc.co.uk thehindu.com indianexpress.com ndtv.com timesofindia.indiatimes.com gov.in nic.in tn.gov.in india.gov.in "
    "whitehouse.gov gov.uk nih.gov cdc.gov who.int"
).split()
TRUSTED_SUFFIXES = (".gov", ".gov.in", ".nic.in", ".edu", ".org")
OFFICIAL = r"\.gov$|\.gouv(?:\.[a-z]{2})?$|\.go\.[a-z]{2}$|\.gov\.[a-z]{2}$|^gov\.[a-z]{2}$|^gc\.ca$|^europa\.eu$|^un\.org$"
OFFICIAL_TRUSTED = r"(?:who\.int|nasa\.gov|isro\.gov\.in|rbi\.org\.in|sec\.gov|imf\.org|worldbank\.org|noaa\.gov|europa\.eu|gov\.uk|usa\.gov)$"


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(trim(url), URL, group)


def raw_host(url: Column) -> Column:
    """Host in lower case without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(part(url, 2), "^.*@", ""), r":\d*$", ""))


def host(url: Column) -> Column:
    return F.regexp_replace(raw_host(url), r"^www\.", "")


def loose_host(url: Column) -> Column:
    """As ``host``; text without a scheme is taken for a host and path."""
    u = trim(url)
    return host(F.when((u != "") & ~u.startswith("http"), F.concat(F.lit("https://"), u)).otherwise(u))


def normalize(url: Column) -> Column:
    """No fragment, scheme and host in lower case, an empty path as a slash; empty where it is no URL."""
    path = part(url, 3)
    return F.when(part(url, 2) == "", F.lit("")).otherwise(
        F.concat(F.lower(part(url, 1)), F.lit("://"), F.lower(part(url, 2)), F.when(path == "", F.lit("/")).otherwise(path), F.when(part(url, 4) == "?", F.lit("")).otherwise(part(url, 4)))
    )


def candidate(url: Column) -> Column:
    return F.when(F.lower(part(url, 1)).isin("http", "https"), normalize(url)).otherwise(F.lit(""))


def canonical_key(url: Column, title: Column | None = None, domain: Column | None = None) -> Column:
    """No fragment, no query, one trailing slash cut, lower case; without a URL title and domain."""
    u = trim(url)
    path = part(url, 3)
    whole = F.concat(part(url, 1), F.lit("://"), part(url, 2), F.when(path == "", F.lit("/")).otherwise(path))
    key = F.lower(F.regexp_replace(whole, "/$", ""))
    none = F.concat(F.lower(s(title) if title is not None else F.lit("")), F.lit("|"), F.lower(s(domain) if domain is not None else F.lit("")))
    return F.when(u == "", none).when(part(url, 2) == "", F.lower(u)).otherwise(key)


def is_trusted_host(domain: Column) -> Column:
    """A listed host or a host below one."""
    hosts = F.array(*[F.lit(h) for h in TRUSTED_HOSTS])
    return (domain != "") & F.exists(hosts, lambda h: (domain == h) | domain.endswith(F.concat(F.lit("."), h)))


def is_trusted_domain(domain: Column) -> Column:
    d = F.lower(trim(domain))
    out = d.isin(TRUSTED_DOMAINS)
    for end in TRUSTED_SUFFIXES:
        out = out | d.endswith(end)
    return (d != "") & out


def is_official(url: Column) -> Column:
    d = host(url)
    return (d != "") & ((is_trusted_host(d) & d.rlike(f"(?i){OFFICIAL_TRUSTED}")) | d.rlike(f"(?i){OFFICIAL}"))


def is_public(url: Column) -> Column:
    """http(s), and neither local nor in a private range."""
    h = raw_host(url)
    private = r"^(?:10\.|127\.|169\.254\.|172\.(?:1[6-9]|2\d|3[01])\.|192\.168\.|0\.)|^\[(?:::1|f[cd]|fe80)"
    return F.lower(part(url, 1)).isin("http", "https") & (h != "") & (h != "localhost") & ~h.endswith(".local") & ~h.endswith(".localhost") & ~h.rlike(private)
