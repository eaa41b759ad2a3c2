"""Scores, stable top-k, keep-first dedupe, vectors. Every order ends in a unique column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import group, has, let, s, without


def hits(words: Column, *weighted: tuple[Column, int]) -> Column:
    """Sum over words of the weight of each text that holds the word."""

    def found(text: Column) -> Column:
        low = F.lower(s(text))
        return F.size(F.filter(words, lambda t: F.contains(low, t)))

    return sum((found(text) * weight for text, weight in weighted), F.lit(0))


def source_score(words: Column, title: Column, description: Column, domain: Column, kind: Column, level: Column, trusted: Column, date: Column) -> Column:
    """Weights of a source's type, trust and date, and of the query words in its fields."""
    k = s(kind)
    score = F.when(s(level) == "structured_claim", 45).otherwise(0) + F.when(F.coalesce(trusted, F.lit(False)), 12).otherwise(0) + F.when(s(date) != "", 2).otherwise(0)
    for name, weight in (("official_source", 30), ("trusted_news", 8), ("encyclopedia", 4), ("structured_reference", 3), ("community_discussion", -6), ("reference_lookup", -12), ("archive_lookup", -16)):
        score = score + F.when(k == name, weight).otherwise(0)
    return score + hits(words, (title, 5), (domain, 4), (description, 2))


def freshness_score(words: Column, age: Column, title: Column, source: Column, summary: Column) -> Column:
    """A quarter of the days left of twenty, and the words in title, source and summary; 1 without words."""
    score = F.greatest(F.lit(0.0), F.lit(20.0) - age) / 4 + hits(words, (title, 8), (source, 5), (summary, 2))
    return F.when(F.size(words) == 0, F.lit(1.0)).otherwise(score)


def fact_score(words: Column, age: Column, title: Column, summary: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(30.0) - age) + hits(words, (title, 10), (summary, 2))


def live_score(words: Column, title: Column, description: Column, domain: Column, kind: Column, trusted: Column, fetched: Column, year: int) -> Column:
    """struct(score, overlap) for live sources; ``year`` is the year it is."""
    hay = F.lower(F.concat_ws(" ", s(title), s(description), s(domain)))
    overlap = F.size(F.filter(words, lambda t: F.contains(hay, t)))
    y = F.nullif(group(hay, r"\b(20\d{2})\b", 1), F.lit("")).cast("int")
    fetched, k = F.coalesce(fetched, F.lit(False)), s(kind)
    score = (
        F.when(overlap > 0, overlap * 2).when(F.size(words) > 0, -2).otherwise(0)
        + F.when(F.coalesce(trusted, F.lit(False)) | k.isin("official_source", "trusted_news"), 3).otherwise(0)
        + F.when(fetched, 2).otherwise(0)
        - F.when((k == "official_source") & ~fetched, 1).otherwise(0)
        + F.when(has(hay, r"\b(latest|today|update|updates|current|now|recent)\b"), 2).otherwise(0)
        + F.when(has(hay, r"\b(reuters|the hindu|indian express|bbc|ap news)\b"), 2).otherwise(0)
        + F.coalesce(F.when(y >= year - 1, 2).when(y <= year - 3, -3), F.lit(0))
    )
    return F.struct(score.alias("score"), overlap.alias("overlap"))


def engine_score(words: Column, position: Column, title: Column, snippet: Column, url: Column) -> Column:
    hay = F.lower(F.concat_ws(" ", s(title), s(snippet), s(url)))
    return (
        F.greatest(F.lit(0), F.lit(100) - position)
        + F.size(F.filter(words, lambda t: F.contains(hay, t))) * 8
        - F.when(s(url).rlike(r"(?i)\.(pdf|zip|rar|7z|mp4|mp3|avi|mov)(?:$|\?)"), 25).otherwise(0)
        + F.when(F.lower(s(url)).startswith("https:"), 2).otherwise(0)
    )


def candidate_score(query: Column, label: Column, description: Column, position: Column) -> Column:
    q, n, d = F.lower(s(query)), F.lower(s(label)), F.lower(s(description))
    return (
        F.greatest(F.lit(0), F.lit(20) - position)
        + F.when(n == q, 30).otherwise(0)
        + F.when(F.contains(n, q) | F.contains(q, n), 12).otherwise(0)
        + F.when(has(d, r"\b(country|sovereign state|state|province|city|municipality|administrative territorial entity|federal state)\b"), 10).otherwise(0)
        - F.when(has(d, r"\b(disambiguation|family name|given name|film|song|album|book)\b"), 15).otherwise(0)
    )


def top_k(df: DataFrame, k: int, order: list[Column], by: list[str] | None = None, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows (of each group); Spark limits groups before the exchange."""
    if not by:
        ordered = df.orderBy(*order).limit(k)
        return ordered.withColumn(rank, F.row_number().over(Window.orderBy(*order)))
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def keep_first(df: DataFrame, key: Column, order: str) -> DataFrame:
    """Per key the row of the lowest order; rows with an empty key go. The winner is found by a combinable aggregate."""
    rows = df.withColumn("_key", key).filter(F.coalesce(F.col("_key"), F.lit("")) != "")
    first = rows.groupBy("_key").agg(F.min(order).alias("_first"))
    return rows.join(first, "_key").filter(F.col(order) == F.col("_first")).drop("_key", "_first")


def keep_last(df: DataFrame, key: Column, order: str) -> DataFrame:
    """Upsert: per key the row of the highest order."""
    rows = df.withColumn("_key", key).filter(F.coalesce(F.col("_key"), F.lit("")) != "")
    last = rows.groupBy("_key").agg(F.max(order).alias("_last"))
    return rows.join(last, "_key").filter(F.col(order) == F.col("_last")).drop("_key", "_last")


def _compared(x: Column) -> Column:
    return F.substring(F.trim(without(s(x), r"\s+", " ")), 1, 1200)


def is_near_duplicate(a: Column, b: Column) -> Column:
    """Equal in the first 1200 characters, or one holds the other's first 300."""
    x, y = _compared(a), _compared(b)
    return (x != "") & (y != "") & ((x == y) | F.contains(x, F.substring(y, 1, 300)) | F.contains(y, F.substring(x, 1, 300)))


def dedupe_sections(sections: Column) -> Column:
    """Keep-first over an array of sections of one document."""
    clean = F.filter(F.transform(sections, lambda x: F.trim(s(x))), lambda x: x != "")
    # each section is put in its compared form once, not once a pair
    shaped = lambda r: F.struct(r["x"].alias("x"), r["c"].alias("c"), F.substring(r["c"], 1, 300).alias("head"))
    rows = F.transform(clean, lambda x: let({"x": x, "c": _compared(x)}, shaped))
    same = lambda x, y: (x["c"] != "") & (y["c"] != "") & ((x["c"] == y["c"]) | F.contains(x["c"], y["head"]) | F.contains(y["c"], x["head"]))
    kept = F.aggregate(rows, F.array().cast("array<struct<x:string,c:string,head:string>>"), lambda acc, x: F.when(F.exists(acc, lambda y: same(y, x)), acc).otherwise(F.array_append(acc, x)))
    return F.transform(kept, lambda r: r["x"])


# --- vectors -----------------------------------------------------------------------------------------


def l2_normalize(v: Column) -> Column:
    """Not-finite values go; a zero vector stays."""
    clean = F.filter(F.transform(v, lambda x: x.cast("double")), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    norm = F.sqrt(F.aggregate(clean, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm == 0, clean).otherwise(F.transform(clean, lambda x: x / norm))


def dot(a: Column, b: Column) -> Column:
    """Inner product; 0 for empty vectors or unequal lengths."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)), F.lit(0.0)).otherwise(product)


def block_entry() -> Column:
    """A vector (vec_id, v) as it stands in a block; a null id is marked, and comes after all others."""
    return F.struct(F.coalesce("vec_id", F.lit(0).cast("long")).alias("vec_id"), "v", F.isnull("vec_id").alias("none"))


def best_of_blocks(k: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For mapInPandas over pairs of blocks (qb_rows, vb_rows): query_id, vec_id and score of the ``k`` best of the block for each of its queries. A null vector has no score: minus infinity, below all scores."""
    length = lambda v: -1 if v is None else len(v)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for left, right in zip(pdf["qb_rows"], pdf["vb_rows"], strict=True):
                ids, none = np.array([x["vec_id"] for x in right], dtype=np.int64), np.array([x["none"] for x in right])
                order = np.lexsort((ids, none))
                ids = np.where(none[order], None, ids[order]) if none.any() else ids[order]
                sizes = np.array([length(x["v"]) for x in right])[order]
                out = []
                for size in {length(x["q"]) for x in left}:
                    asked = [x for x in left if length(x["q"]) == size]
                    fits = (sizes == size) & (size > 0)
                    scores = np.tile(np.where((sizes < 0) | (size < 0), -np.inf, 0.0), (len(asked), 1))
                    if fits.any():
                        # one dimension after the other, as ``dot`` adds: equal vectors get equal scores, so ties fall to the id
                        a, b = np.stack([x["q"] for x in asked]), np.stack([right[i]["v"] for i in order[fits]])
                        scores[:, fits] = sum(np.multiply.outer(a[:, d], b[:, d]) for d in range(size))
                    top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                    out.extend((x["query_id"], ids[t], row[t]) for x, row, places in zip(asked, scores, top, strict=True) for t in places)
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "x"], dtype=object if none.any() else None)

    return best


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int, block: int = 512) -> DataFrame:
    """query_id, vec_id, place: the ``k`` best of ``vectors`` (vec_id, v) for each of ``queries`` (query_id, q), by inner product, then vec_id.

    Both sides are packed into blocks of about ``block`` rows. Each pair of blocks gives the best ``k`` of its rows for each
    query, and these are merged per query; no side is broadcast. Vectors of unequal length score 0. Null vectors have no score and come after
    all others, by vec_id (a null id last); so a null query gets the ``k`` smallest ids.
    """
    n = "greatest(1, CAST(ceil(count(1) / {}D) AS INT)) AS n".format(block)

    def blocks(df: DataFrame, id_col: str, entry: Column, at: str) -> DataFrame:
        count = df.selectExpr(n)  # one row
        return df.join(F.broadcast(count)).groupBy(F.pmod(F.xxhash64(id_col), F.col("n")).alias(at)).agg(F.collect_list(entry).alias(f"{at}_rows"))

    # blocks of queries go to the blocks of vectors by key: each is copied once a block of the other side
    left, right = blocks(queries, "query_id", F.struct("query_id", "q"), "qb"), blocks(vectors, "vec_id", block_entry(), "vb")
    grid = vectors.selectExpr(n)  # one row
    dealt = left.join(F.broadcast(grid)).withColumn("vb", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
    pairs = dealt.join(right.withColumn("vb", F.col("vb").cast("int")).hint("shuffle_hash"), "vb").select("qb_rows", "vb_rows")
    scored = pairs.mapInPandas(best_of_blocks(k), "query_id long, vec_id long, x double")
    return top_k(scored, k, [F.desc("x"), F.asc_nulls_last("vec_id")], ["query_id"], "place").select("query_id", "vec_id", F.col("place").cast("int"))


def retrieve_then_rerank(scored: DataFrame, logits: DataFrame, first: int = 20, id_col: str = "id") -> DataFrame:
    """id, place: the ``first`` best by score are put in order of their logits (rows without one after them), the rest follows by score.

    ``scored`` has id and score, ``logits`` id and logit (null or not finite sorts last).
    """
    head = scored.orderBy(F.desc("score"), id_col).limit(first).join(logits.select(id_col, "logit").withColumn("rated", F.lit(True)), id_col, "left")
    rest = scored.join(head.select(id_col), id_col, "left_anti")
    logit = F.when(F.col("logit").isNull() | F.isnan("logit"), F.lit(float("-inf"))).otherwise(F.col("logit"))
    a = head.select(id_col, F.when(F.col("rated"), 0).otherwise(1).alias("tier"), F.when(F.col("rated"), logit).otherwise(F.col("score")).alias("key"))
    b = rest.select(id_col, F.lit(2).alias("tier"), F.col("score").alias("key"))
    return a.unionByName(b)


def rank_items(items: DataFrame, by: str, order: str, most: int = 48, width: int = 2000) -> DataFrame:
    """by, id, text: the first items of a group with the first non-blank of text, description, value, title; others get a running id."""
    from ..functions.text import collapse, first_string

    place = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    rows = items.withColumn("_p", place).filter(F.col("_p") < most)
    text = F.substring(first_string(*[collapse(F.col(c)) for c in ("text", "description", "value", "title") if c in items.columns]), 1, width)
    known = [F.nullif(F.trim(s(F.col(c))), F.lit("")) for c in ("id", "key") if c in items.columns]
    return rows.select(by, F.coalesce(*known, F.concat(F.lit("item_"), F.col("_p"))).alias("id"), text.alias("text")).filter("text <> ''")
