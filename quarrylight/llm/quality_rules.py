r"""Quality rules over words, symbols and lines, DataFrame functions only.

Per text: base counts (see ``base_counts``). Across texts: lines are normalised (lower case, white space
collapsed, trimmed) and hashed, and per host (``source``) the documents that hold a line are counted, twice:

1. documents that are equal in text count as one. Lines in more than ``max(min_docs, max_share * documents of the host)``
   of them are frequent, of whatever length;
2. documents that are *otherwise different* count once each: frequent lines make at most half of such a document's words, and
   documents with the same least hash of their other lines count as one. A frequent line that more of these than the same
   limit hold is boilerplate. So a page republished often, with edits, is not taken for boilerplate of its host.

Boilerplate is removed; a text that loses more than ``max_removed`` of its words that way is depleted and rejected.

Skew: rows first collapse to (host, text hash, line), which spreads a hot line over its texts and a hot
text over one row a line, which is staged; the count per (host, line, salt) is combined before (host, line). Joins back
go over (host, line, salt); the last one, to the rows of a hot text, is split by adaptive execution.

Defined cases: null text is empty (0 words, base_failed); null source is a host of its own; rows that
repeat an id are judged each on its text; an empty table gives an empty result; a doc without a line that
has a word loses nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_WS, WS, salts, stage, text_of, unstage

MIN_WORDS = 50
MIN_DOCS = 20
MAX_SHARE = 0.002
MAX_REMOVED = 0.5


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more. Windows are compared by 64-bit hash."""
    windows = F.when(
        F.size(words) >= 4,
        F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    return windows


def base_counts(docs: DataFrame, text: str = "t") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed for the column ``t``."""
    t = F.col(text)
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(NOT_WS))
    out = docs.withColumns({"_w": F.regexp_extract_all(t, F.lit(f"({NOT_WS}+)"), 1), "_l": lines})
    out = out.withColumn("_g", repeat_words(F.col("_w")))
    # windows in hash order, each with its place; a window repeats where a neighbour in that order is equal
    out = out.withColumn(
        "_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.array_sort(F.transform("_g", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    )
    out = out.withColumn(
        "_p",
        F.expr(
            "array_sort(transform(filter(transform(_s, (x, j) -> struct(x.i AS i, (j > 0 AND x.h = _s[greatest(j - 1, 0)].h)"
            " OR (j < size(_s) - 1 AND x.h = _s[least(j + 1, size(_s) - 1)].h) AS r)), x -> x.r), x -> x.i))"
        ),
    )
    n_repeat = F.expr("coalesce(aggregate(transform(_p, (x, j) -> CASE WHEN j = size(_p) - 1 THEN 3 ELSE least(3, _p[j + 1] - x) END), 0, (a, x) -> a + x), 0)")
    return out.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.regexp_replace(t, f"{WS}+", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_repeat_words": n_repeat.cast("long"),
        }
    ).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).drop("_w", "_l", "_g", "_s", "_p")


def line_key(line: Column) -> Column:
    """60 bits of a normalised line's MD5, as a number."""
    return F.conv(F.substring(F.md5(F.lower(F.trim(F.regexp_replace(line, f"{WS}+", " ")))), 1, 15), 16, 10).cast("long")


def _boilerplate(rows: DataFrame, min_docs: int, max_share: float, n_salts: int) -> DataFrame:
    """(host, c, all_words, hs): per text the boilerplate lines and their words in all its copies; ``rows`` has host, c, t."""
    lines = (
        rows.select("host", "c", F.explode(F.filter(F.split("t", "\n", -1), lambda x: x.rlike(NOT_WS))).alias("line"))
        .select("host", "c", line_key(F.col("line")).alias("h"), F.size(F.regexp_extract_all("line", F.lit(f"({NOT_WS}+)"), 1)).alias("n"))
    )
    # per copy of a text every line counts as often as it stands in one copy: copies are divided out below
    held = lines.groupBy("host", "c", "h").agg(F.sum("n").alias("all_words"))
    held = stage(held.withColumn("s", F.pmod("c", F.lit(n_salts))), "lines")
    salted = held.groupBy("host", "h", "s").agg(F.count(F.lit(1)).alias("k"))
    hosts = rows.select("host", "c").distinct().groupBy("host").agg(F.greatest(F.lit(float(min_docs)), F.lit(max_share) * F.count(F.lit(1))).alias("limit"))
    total = salted.groupBy("host", "h").agg(F.sum("k").alias("k"))
    frequent = total.join(hosts, total.host.eqNullSafe(hosts.host)).filter(F.col("k") > F.col("limit")).select(total.host, "h", "limit")
    keys = salted.select("host", "h", "s").alias("a").join(frequent.alias("f"), F.expr("a.h = f.h AND a.host <=> f.host")).select("a.host", "a.h", "a.s", "f.limit")
    marked = stage(
        held.alias("x").join(keys.alias("k"), F.expr("x.h = k.h AND x.s = k.s AND x.host <=> k.host"), "left").select("x.*", "k.limit"), "marked"
    )
    unstage(held)
    is_often = F.col("limit").isNotNull()
    own = marked.groupBy("host", "c").agg(F.sum("all_words").alias("all"), F.sum(F.when(is_often, F.col("all_words")).otherwise(0)).alias("often"), F.min(F.when(~is_often, F.col("h"))).alias("sig"))
    own = own.filter("2 * often <= all").select("host", "c", "sig")
    often = marked.filter(is_often)
    held_by = often.alias("x").join(own.alias("o"), F.expr("x.c = o.c AND x.host <=> o.host")).select("x.host", "x.h", "x.limit", "o.sig").distinct()
    spread = held_by.groupBy("host", "h").agg(F.count(F.lit(1)).alias("k"), F.max("limit").alias("limit")).filter("k > limit")
    at = often.select("host", "h", "s").distinct().alias("a").join(spread.alias("f"), F.expr("a.h = f.h AND a.host <=> f.host")).select("a.host", "a.h", "a.s")
    bad = often.alias("x").join(at.alias("k"), F.expr("x.h = k.h AND x.s = k.s AND x.host <=> k.host")).select("x.host", "x.c", "x.h", "x.all_words")
    per = stage(bad.groupBy("host", "c").agg(F.sum("all_words").alias("all_words"), F.collect_set("h").alias("hs")), "boilerplate")
    unstage(marked)
    return per


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_docs: int = MIN_DOCS,
    max_share: float = MAX_SHARE,
    max_removed: float = MAX_REMOVED,
    carry: tuple[str, ...] = (),
    clean: bool = False,
) -> DataFrame:
    """doc_id, the base counts, base_failed, n_boilerplate_words, kept; with ``clean`` also ``clean_text``, the text without boilerplate lines.

    ``carry`` names input columns to pass through under ``in_<name>``.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), text_of(text_col).alias("t"), F.xxhash64(text_of(text_col)).alias("c"), *[F.col(c).alias(f"in_{c}") for c in carry]
    )
    per = _boilerplate(rows.select("host", "c", "t"), min_docs, max_share, salts(spark))
    copies = rows.groupBy("host", "c").agg(F.count(F.lit(1)).alias("copies"))
    per = per.alias("p").join(copies.alias("q"), F.expr("p.c = q.c AND p.host <=> q.host")).select("p.*", (F.col("p.all_words") / F.col("q.copies")).cast("long").alias("lost"))
    judged = base_counts(rows).drop(*([] if clean else ["t"]))
    out = judged.alias("d").join(per.alias("p"), F.expr("d.c = p.c AND d.host <=> p.host"), "left")
    lost = F.coalesce(F.col("p.lost"), F.lit(0)).cast("long")
    cols = [
        F.col("d.id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (lost <= F.lit(max_removed) * F.col("n_words"))).alias("kept"), lost.alias("n_boilerplate_words"),
    ]
    if clean:
        kept = F.filter(F.split("d.t", "\n", -1), lambda x: ~F.array_contains(F.col("p.hs"), line_key(x)))
        cols.append(F.when(F.col("p.hs").isNull(), F.col("d.t")).otherwise(F.array_join(kept, "\n")).alias("clean_text"))
    return out.select(*cols, *[F.col(f"d.in_{c}") for c in carry])
