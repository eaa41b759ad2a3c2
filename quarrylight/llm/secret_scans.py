r"""Secret scans with multipart credential linking, DataFrame functions only.

Base spans stand by themselves: ``assign`` (a keyword with a value), ``access`` (key identifiers of fixed form) and ``hex`` (long
hexadecimal strings). Weak parts are far too common to be reported alone: ``identifier`` (a user, client or account with a value),
``endpoint`` (a URL) and ``secret`` (a long string of mixed letters and digits). They are reported where complementary parts co-occur:

* the scope of an identifier (``access`` or ``identifier``) is the text up to ``reach`` code points before and after it;
* a ``secret`` is reported if it meets the scope of an identifier, an ``identifier`` if its scope meets a secret (``assign``, ``hex`` or ``secret``);
* an ``endpoint`` is reported if it meets the scope of an identifier that has a secret there too.

A weak ``identifier`` or ``secret`` that overlaps a base span is that finding again and is left out, as is a ``secret`` inside an identifier or an endpoint.

One scan of the texts leaves a thin table: per text and kind the length of each match and of the gap before it. Places are running sums over
these, so no text moves. The interval join meets on (row, bin of ``reach`` code points) with the overlap as condition: a text full of
parts spreads over its bins, and a bin holds at most as many parts as fit in it. What is left per part is whether it met another.

Defined cases: null text is empty and has no spans; each row, repeated ids and null ids too, is scanned and returned on its own; spans of any
length and number are kept; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, text_of, unstage

REACH = 256
#: The kinds in the order in which spans with one start are listed.
KINDS = ["assign", "access", "hex", "identifier", "secret", "endpoint"]
BASE = KINDS[:3]


def either_case(words: str) -> str:
    """The pattern ``words`` with its letters in either case, as classes: no engine's folding beyond A-Z applies."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


ASSIGN = "(" + either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
IDENTIFIER = "(" + either_case("access_?key_?id|client_?id|account_?id|tenant_?id|user_?name|user|login") + r""")["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{4,}"""
SECRET = "[A-Za-z0-9+/_-]{32,}={0,2}"
ENDPOINT = r"[a-z][a-z0-9+.-]*://[A-Za-z0-9.:@/_%?&=+~-]+"

_MATCHES = "array<struct<gap:int,len:int,ok:boolean>>"


def _matches(text: Column, pattern: str, ok, gate: Column | None = None) -> Column:
    """Per match of ``pattern`` the code points before it since the last one, its own, and whether it stands. ``gate`` is a cheap condition that every match implies."""
    hits, rest = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    found = F.zip_with(hits, F.slice(rest, F.lit(1), F.size(hits)), lambda m, gap: F.struct(F.length(gap).alias("gap"), F.length(m).alias("len"), ok(m).alias("ok")))
    may = text.rlike(pattern) if gate is None else gate & text.rlike(pattern)
    return F.when(may, found).otherwise(F.array().cast(_MATCHES))


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and, under each kind's name, its matches. Secrets and endpoints are sought only where there is an identifier: without one neither is reported."""
    t, always = F.col("t"), lambda m: F.lit(True)
    sets = t.contains("=") | t.contains(":")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t")).withColumns(
        {
            "assign": _matches(t, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6, sets),
            "access": _matches(t, ACCESS, always, t.contains("AKIA")),
            "hex": _matches(t, HEX, always),
            "identifier": _matches(t, IDENTIFIER, always, sets),
        }
    )
    named = (F.size("access") > 0) | (F.size("identifier") > 0)
    mixed = lambda m: m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")
    return rows.withColumns({"secret": _matches(t, SECRET, mixed, named), "endpoint": _matches(t, ENDPOINT, always, named & t.contains("://"))}).drop("t")


def _placed(rows: DataFrame) -> DataFrame:
    """(rid, kind, start, end) of all matches that stand, without weak parts that are other findings again."""
    each = F.concat(*[F.expr(f"transform({k}, (m, i) -> struct({r} AS kind, i, m.gap, m.len, m.ok))") for r, k in enumerate(KINDS)])
    parts = rows.select("rid", F.explode(each).alias("m")).select("rid", "m.*").repartition("rid")
    before = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap").cast("long") + F.col("len")).over(before)
    parts = parts.withColumn("end", end).filter("ok").select("rid", "kind", (F.col("end") - F.col("len")).alias("start"), "end")
    place, before_it = ["start", "kind", "end"], (Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("rid").orderBy(*place).rowsBetween(*before_it)
    later = Window.partitionBy("rid").orderBy(*[F.desc(c) for c in place]).rowsBetween(*before_it)  # backwards: a frame that grows, not one that is summed anew for each row

    def covered(kinds: list[str]) -> Column:
        inside = F.col("kind").isin([KINDS.index(k) for k in kinds])
        first, last = F.min(F.when(inside, F.col("start"))).over(later), F.max(F.when(inside, F.col("end"))).over(earlier)
        return F.coalesce(last > F.col("start"), F.lit(False)) | F.coalesce(first < F.col("end"), F.lit(False))

    kind = F.col("kind")
    parts = parts.withColumns({"_found": covered(BASE), "_held": covered(["identifier", "endpoint"])})
    again = (kind.isin(KINDS.index("identifier"), KINDS.index("secret")) & F.col("_found")) | ((kind == KINDS.index("secret")) & F.col("_held"))
    return parts.filter(~again).drop("_found", "_held")


def _meet(scopes: DataFrame, parts: DataFrame, reach: int) -> DataFrame:
    """The columns of ``scopes`` and, as p_kind, p_start and p_end, of the parts that each meets. A pair comes once per bin that both touch."""
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / reach), F.floor((b - 1) / reach)))
    left = scopes.withColumn("bin", bins(F.col("start") - reach, F.col("end") + reach)).alias("s")
    right = parts.select("rid", F.col("kind").alias("p_kind"), F.col("start").alias("p_start"), F.col("end").alias("p_end"), bins(F.col("start"), F.col("end")).alias("bin")).alias("p")
    return left.join(right, F.expr(f"s.rid = p.rid AND s.bin = p.bin AND p_start < s.end + {reach} AND p_end > s.start - {reach}")).select("s.rid", "s.kind", "s.start", "s.end", "p_kind", "p_start", "p_end")


def _linked(parts: DataFrame, reach: int) -> DataFrame:
    """(rid, kind, start, end) of the weak parts that are reported."""
    of = lambda *kinds: parts.filter(F.col("kind").isin([KINDS.index(k) for k in kinds]))
    pairs = _meet(of("access", "identifier"), of("assign", "hex", "secret"), reach)
    named = pairs.select("rid", "kind", "start", "end").distinct()
    secrets = pairs.select("rid", F.col("p_kind").alias("kind"), F.col("p_start").alias("start"), F.col("p_end").alias("end")).distinct()
    ends = _meet(named, of("endpoint"), reach).select("rid", F.col("p_kind").alias("kind"), F.col("p_start").alias("start"), F.col("p_end").alias("end")).distinct()
    return named.unionByName(secrets).unionByName(ends).filter(F.col("kind") >= len(BASE))


def secret_scans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """doc_id, spans: one row per input row; spans is an array of (start, kind, end) in order, places in code points, end exclusive."""
    rows = stage(scan(docs, id_col, text_col).withColumn("rid", F.monotonically_increasing_id()), "matches")
    some = F.greatest(*[F.size(k) for k in KINDS]) > 0
    parts = stage(_placed(rows.filter(some)), "parts")
    reported = parts.filter(F.col("kind") < len(BASE)).unionByName(_linked(parts, reach))
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = reported.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    spans = spans.withColumn("spans", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), names[s["kind"]].alias("kind"), s["end"].alias("end"))))
    out = stage(rows.select("rid", "doc_id").join(spans, "rid", "left").select("doc_id", F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:string,end:bigint>>")).alias("spans")), "spans")
    unstage(rows, parts)
    return out


def span_digests(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_linked, the number of spans that linking added."""
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(BASE))
    n = {f"n_{k}": F.expr(f"CAST(size(filter(spans, s -> s.kind = '{k}')) AS BIGINT)") for k in BASE}
    return scanned.select(
        "doc_id", *[c.alias(k) for k, c in n.items()], F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_linked")
    )


#: The same rows. Patterns are written out; places come from the pieces between the matches.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
k AS (SELECT * FROM (VALUES
  (0, 'assign', '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'),
  (1, 'access', 'AKIA[A-Z0-9]+'), (2, 'hex', '[0-9a-f]+'),
  (3, 'identifier', '(?:[Aa][Cc][Cc][Ee][Ss][Ss]_?[Kk][Ee][Yy]_?[Ii][Dd]|[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt]_?[Ii][Dd]|[Tt][Ee][Nn][Aa][Nn][Tt]_?[Ii][Dd]|[Uu][Ss][Ee][Rr]_?[Nn][Aa][Mm][Ee]|[Uu][Ss][Ee][Rr]|[Ll][Oo][Gg][Ii][Nn])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9@._-]{4,}'),
  (4, 'secret', '[A-Za-z0-9+/_-]{32,}={0,2}'), (5, 'endpoint', '[a-z][a-z0-9+.-]*://[A-Za-z0-9.:@/_%?&=+~-]+')) v(kind, name, p)),
m AS (SELECT rid, 0 AS kind, regexp_extract_all(t, (SELECT p FROM k WHERE kind = 0)) AS ms, regexp_split_to_array(t, (SELECT p FROM k WHERE kind = 0)) AS gs FROM d
  UNION ALL SELECT rid, 1, regexp_extract_all(t, (SELECT p FROM k WHERE kind = 1)), regexp_split_to_array(t, (SELECT p FROM k WHERE kind = 1)) FROM d
  UNION ALL SELECT rid, 2, regexp_extract_all(t, (SELECT p FROM k WHERE kind = 2)), regexp_split_to_array(t, (SELECT p FROM k WHERE kind = 2)) FROM d
  UNION ALL SELECT rid, 3, regexp_extract_all(t, (SELECT p FROM k WHERE kind = 3)), regexp_split_to_array(t, (SELECT p FROM k WHERE kind = 3)) FROM d
  UNION ALL SELECT rid, 4, regexp_extract_all(t, (SELECT p FROM k WHERE kind = 4)), regexp_split_to_array(t, (SELECT p FROM k WHERE kind = 4)) FROM d
  UNION ALL SELECT rid, 5, regexp_extract_all(t, (SELECT p FROM k WHERE kind = 5)), regexp_split_to_array(t, (SELECT p FROM k WHERE kind = 5)) FROM d),
e AS (SELECT rid, kind, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g FROM m WHERE len(ms) > 0),
q AS (SELECT rid, kind, m, CAST(sum(length(g) + length(m)) OVER (PARTITION BY rid, kind ORDER BY i) AS BIGINT) AS fin FROM e),
s AS (SELECT rid, kind, fin - length(m) AS st, fin FROM q WHERE CASE kind
  WHEN 0 THEN length(regexp_extract(m, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1)) >= 6 WHEN 1 THEN length(m) >= 20 WHEN 2 THEN length(m) >= 24
  WHEN 4 THEN regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') ELSE true END),
parts AS (SELECT * FROM s a WHERE NOT (kind IN (3, 4) AND EXISTS (SELECT 1 FROM s b WHERE b.rid = a.rid AND b.kind < 3 AND b.st < a.fin AND b.fin > a.st))
  AND NOT (kind = 4 AND EXISTS (SELECT 1 FROM s b WHERE b.rid = a.rid AND b.kind IN (3, 5) AND b.st < a.fin AND b.fin > a.st))),
pairs AS (SELECT a.rid, a.kind, a.st, a.fin, b.kind AS k2, b.st AS st2, b.fin AS fin2 FROM parts a JOIN parts b ON a.rid = b.rid AND a.kind IN (1, 3) AND b.kind IN (0, 2, 4) AND b.st < a.fin + 256 AND b.fin > a.st - 256),
rep AS (SELECT rid, kind, st, fin FROM parts WHERE kind < 3 UNION SELECT rid, kind, st, fin FROM pairs UNION SELECT rid, k2, st2, fin2 FROM pairs
  UNION SELECT b.rid, b.kind, b.st, b.fin FROM pairs a JOIN parts b ON a.rid = b.rid AND b.kind = 5 AND b.st < a.fin + 256 AND b.fin > a.st - 256),
g AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind > 2) AS n_linked,
  string_agg(name || ':' || st || ':' || fin, ',' ORDER BY st, kind) FILTER (kind < 3) AS base, string_agg(name || ':' || st || ':' || fin, ',' ORDER BY st, kind) AS spans FROM rep JOIN k USING (kind) GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_linked, 0) AS n_linked, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)
"""
