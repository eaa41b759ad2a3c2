"""Request logs: the path a request came by, its client, and whether it is let in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import is_abusive
from ..functions.text import s, trim
from .state import rate_limit

#: What a rejected request is told, by status.
ERRORS = {200: "answered", 400: "abusive_payload", 403: "origin_not_allowed", 405: "method_not_allowed", 413: "request_too_large", 415: "unsupported_media_type", 429: "rate_limited"}


def request_path(*candidates: Column) -> Column:
    """The path of the first candidate (URL or path) that is not blank: no query, single slashes, none at the end."""
    value = F.coalesce(*[F.nullif(trim(c), F.lit("")) for c in candidates], F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(value, r"^https?://[^/?#]*", ""), r"[?#].*$", "")
    path = F.regexp_replace(F.regexp_replace(F.concat(F.lit("/"), bare), "/+", "/"), "/$", "")
    return F.when(value == "", "").when(path == "", "/").otherwise(path)


def route_of(path: Column, routes: list[str], retired: list[str]) -> Column:
    """struct(route, status): the listed route of a path, 410 for retired ones, 404 for others."""
    status = F.when(path.isin(*routes), 200).when(path.isin(*retired), 410).otherwise(404)
    return F.struct(F.when(status != 404, path).alias("route"), status.alias("status"))


def client_ip(forwarded: Column, real: Column, remote: Column) -> Column:
    """The first forwarded address, else the proxy's, else the socket's."""
    first = F.trim(F.split(s(forwarded), ",")[0])
    return F.coalesce(*[F.nullif(trim(c), F.lit("")) for c in (first, real, remote)], F.lit("unknown"))


def screen(method: Column, content_type: Column, n_bytes: Column, body: Column, origin_ok: Column, methods: list[str], most_bytes: int) -> Column:
    """The status a request is turned away with before any limit is counted; null where it goes on."""
    return (
        F.when(~F.coalesce(origin_ok, F.lit(False)), 403)
        .when(s(method).isin("OPTIONS", "HEAD"), 200)
        .when(~s(method).isin(*methods), 405)
        .when(F.lit("POST" in methods) & ~F.contains(F.lower(s(content_type)), F.lit("application/json")), 415)
        .when(n_bytes > most_bytes, 413)
        .when(F.coalesce(is_abusive(body), F.lit(False)), 400)
    )


def admit(log: DataFrame, client: str, at: Column, order: str, limit: int, window_ms: int, methods: tuple[str, ...] = ("POST",), most_bytes: int = 1_000_000) -> DataFrame:
    """order, status, error: one row per request of a log with method, content_type, n_bytes, body, origin_ok.

    Only requests that pass the screen count towards the limit of their client.
    """
    status = screen(*[F.col(c) for c in ("method", "content_type", "n_bytes", "body", "origin_ok")], methods=list(methods), most_bytes=most_bytes)
    seen = log.withColumns({"_status": status, "_at": at})
    limited = rate_limit(seen.filter("_status IS NULL"), client, F.col("_at"), F.col(order), limit, window_ms).select(F.col("id").alias(order), F.when(F.col("allowed"), 0).otherwise(429).alias("_limited"))
    out = seen.join(limited, order, "left").withColumn("status", F.nullif(F.coalesce("_status", "_limited"), F.lit(0)))
    names = F.create_map(*[F.lit(v) for kv in ERRORS.items() for v in kv])
    return out.select(order, "status", names[F.col("status")].alias("error"))
