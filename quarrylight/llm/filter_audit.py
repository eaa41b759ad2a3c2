r"""Filter interaction audit: what each of five filters removes, alone, in every order and on average over the orders.

A relational word pipeline: texts go to their key's partition once; there words are exploded, counted per (document, word) and then per
document, all in that partitioning. The other failure flags come from a scan of their own as thin rows and are joined to the totals.
Each document then is one of 32 failure masks. Per part three times 32 conditional counts (all, good, toxic documents) hold all that any order
of the filters can tell, so the 120 orders are read off 96 numbers a part and no document is looked at again.

Failure conditions: A fewer than 100 words; B fewer than 80 distinct words in 100; C more than 10 capitals A-Z in 100 code points;
D any of ``#$%&*|``; E the text of a document with a smaller id, in the whole table and whether removed or not.

Equal texts are found by SHA-256. The smallest id per digest is combined map-side, and documents find it over (digest, id), never over a hot digest.

Defined cases: null text is empty (no words: fails A only, unless repeated); null lang is the part ``''``; a null id is larger than every id,
so it fails E where its text has a real id and is no copy of another null id; rows that repeat id and text count each, and none is the
other's copy; labels that repeat an id count if any of its rows does; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, stage, text_of, unstage, watched

FILTERS = "ABCDE"
MIN_WORDS = 100
MIN_DISTINCT = 80
MAX_CAPITALS = 10


def word_totals(docs: DataFrame) -> DataFrame:
    """(id, h, n_words, n_distinct) of documents (id, h, t) that have a word. Rows equal in id and text share a key, and their words are counted together."""
    placed = docs.select("id", "h", "t").repartition("id", "h")
    words = placed.select("id", "h", F.explode(F.split("t", WS + "+", -1)).alias("word")).filter("word != ''")
    per_word = words.groupBy("id", "h", "word").agg(F.count(F.lit(1)).alias("n"))
    return per_word.groupBy("id", "h").agg(F.sum("n").alias("n_words"), F.count(F.lit(1)).alias("n_distinct"))


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, rows, a, b, c, d, e): per key of id, text and part the number of its rows and whether they fail each filter."""
    t = F.col("t")
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_of(text_col).alias("t")).withColumn("h", F.xxhash64("t"))
    flags = base.select(
        "id", "h", "part", F.sha2("t", 256).alias("digest"),
        (100 * F.regexp_count(t, F.lit("[A-Z]")).cast("long") > MAX_CAPITALS * F.length(t)).alias("c"), t.rlike(r"[#$%&*|]").alias("d"),
    ).groupBy("id", "h", "part", "digest", "c", "d").agg(F.count(F.lit(1)).alias("rows"))
    # both scans of the texts end in thin tables, so neither is made again when a join above is planned anew
    flags, words = stage(flags, "flags"), stage(word_totals(base), "totals")
    least = flags.groupBy("digest").agg(F.min("id").alias("least"))
    first = least.select(F.col("digest").alias("k_digest"), F.col("least").alias("k_id"), F.lit(True).alias("first"))
    # a null id is the first only where its text has no other id
    marked = flags.join(first, (F.col("digest") == F.col("k_digest")) & F.col("id").eqNullSafe(F.col("k_id")), "left")
    copies = flags.groupBy("id", "h").agg(F.sum("rows").alias("copies"))
    totals = words.alias("w").join(copies.alias("k"), F.expr("w.id <=> k.id AND w.h = k.h")).select(
        "w.id", "w.h", (F.col("n_words") / F.col("copies")).cast("long").alias("n_words"), "n_distinct"
    )
    n, distinct = F.coalesce("n_words", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    return marked.alias("f").join(totals.alias("w"), F.expr("f.id <=> w.id AND f.h = w.h"), "left").select(
        "f.id", "part", "rows", (n < MIN_WORDS).alias("a"), (100 * distinct < MIN_DISTINCT * n).alias("b"), "c", "d", F.col("first").isNull().alias("e")
    )


def mask_counts(failed: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """part and the 96 counts n_00 ... n_31, good_00 ..., toxic_00 ...: documents by failure mask, A the lowest bit."""
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("l_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    bits = sum((F.col(c).cast("int") * 2**k for k, c in enumerate("abcde")), F.lit(0))
    rows = failed.withColumn("mask", bits).join(known, F.col("id") == F.col("l_id"), "left")

    def count(name: str, m: int, also: Column | None) -> Column:
        hit = F.col("mask") == m
        return F.coalesce(F.sum(F.when(hit if also is None else hit & also, F.col("rows"))), F.lit(0)).alias(f"{name}_{m:02}")

    return rows.groupBy("part").agg(*[count(n, m, f) for n, f in (("n", None), ("good", F.col("good")), ("toxic", F.col("toxic"))) for m in range(32)])


def orders(counts: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of the step, for each part, all orders of the filters and their steps. The 600 steps are constants."""
    steps = [(o, s + 1, 1 << FILTERS.index(x), sum(1 << FILTERS.index(y) for y in o[:s])) for o in map("".join, permutations(FILTERS)) for s, x in enumerate(o)]
    step = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(own).alias("own"), F.lit(before).alias("before")) for o, s, own, before in steps])
    by_mask = {n: F.array(*[F.col(f"{n}_{m:02}") for m in range(32)]).alias(n) for n in ("n", "good", "toxic")}
    rows = counts.select("part", *by_mask.values()).select("part", "n", "good", "toxic", F.explode(step).alias("s")).select("part", "n", "good", "toxic", "s.*")
    masks = "sequence(0, 31)"
    total = lambda of, where: F.expr(f"aggregate(filter({masks}, m -> {where}), 0L, (x, m) -> x + {of}[m])")
    removed = "(m & own) != 0 AND (m & before) = 0"
    return rows.select(
        "part", "filter_order", "step",
        total("n", "(m & (own | before)) = 0").alias("kept"), total("n", removed).alias("removed"), total("n", "(m & own) != 0 AND (m & before) != 0").alias("redundant"),
        total("n", "m = own").alias("unique_fails"), total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"),
        # among the k filters that a document fails, each comes first in 120 / k of the orders
        F.expr(f"aggregate(filter({masks}, m -> (m & own) != 0), 0L, (x, m) -> x + n[m] * (120 div bit_count(m)))").alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, filter_order, step and the counts: 600 rows per part."""
    with watched() as mine:
        counts = stage(mask_counts(failures(docs, id_col, text_col, part_col), labels, id_col), "counts")
    unstage(*(t for t in list(mine) if t is not counts))
    return orders(counts)


#: The same rows by the definition: every document goes through every order.
SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT d.r, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [len(ws) < 100, 100 * list_unique(ws) < 80 * len(ws), 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t),
  regexp_matches(t, '[#$%&*|]'), d.doc_id IS DISTINCT FROM min(d.doc_id) OVER (PARTITION BY t)] AS fails FROM d JOIN w USING (r) LEFT JOIN l ON d.doc_id = l.doc_id),
o AS (SELECT '' AS o UNION ALL SELECT o || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(o, x)),
s AS (SELECT o, i AS step, ascii(substr(o, CAST(i AS INT), 1)) - 64 AS own, list_transform(string_split(substr(o, 1, CAST(i AS INT) - 1), ''), lambda x: ascii(x) - 64) AS before FROM (SELECT o, unnest([1, 2, 3, 4, 5]) AS i FROM o WHERE length(o) = 5)),
x AS (SELECT part, o, step, own, good, toxic, fails[own] AS bad, step > 1 AND list_bool_or(list_transform(before, lambda b: fails[b])) AS gone, len(list_filter(fails, lambda y: y)) AS n FROM f, s),
a AS (SELECT part, o, step, own, count(*) FILTER (NOT bad AND NOT gone) AS kept, count(*) FILTER (bad AND NOT gone) AS removed, count(*) FILTER (bad AND gone) AS redundant, count(*) FILTER (bad AND n = 1) AS unique_fails,
  count(*) FILTER (bad AND NOT gone AND good) AS good_lost, count(*) FILTER (bad AND NOT gone AND toxic) AS toxic_lost FROM x GROUP BY part, o, step, own)
SELECT part, o AS filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM a
"""
