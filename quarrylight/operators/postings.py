"""Ranked search of many queries over many chunks by an inverted index, with the candidates of each query pruned by what a chunk can still score.

The score of a chunk is the number of the query's terms that occur in it, as in the searches that score every chunk; equal scores fall to the smaller key.
A term occurs in a text exactly if it is part of one of the text's runs of letters and digits, so the index is by these runs (tokens):

* ``postings``: (token, block, n, keys): the chunks that hold a token, in blocks of about ``BLOCK`` chunks, so that a token in every chunk spreads over blocks;
* ``vocabulary``: (token, n). A term finds its tokens over their trigrams, an equi-join that is checked by containment.

The terms of a query are put in order of how many chunks hold them (an upper bound). The chunks of its rarest terms, until ``k`` chunks are sure, are scored
in full; the score of the ``k``-th best is a bound that every row of the result reaches. A chunk that holds only the ``bound - 1`` most frequent terms cannot reach it, so these terms'
lists are never read: candidates come from the other terms alone and are scored in full by their texts. The rows are those of scoring everything.

Defined cases: a query without terms, and one whose terms occur nowhere, has no rows; chunks that hold no term are never returned; fewer than ``k``
chunks with a term give fewer rows; null texts are empty; empty tables give empty results. Keys of chunks and queries have to be unique.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settings, written
from .rank import top_k

BLOCK = 4096
#: Rows of an Arrow batch while chunks are made.
BATCH = 1000
#: Terms shorter than this are not looked up.
LEAST = 3


@dataclass(frozen=True)
class Index:
    chunks: DataFrame  # key, text (lower case)
    postings: DataFrame  # token, block, n, keys
    vocabulary: DataFrame  # token, n


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[a-z0-9]{{{LEAST},}}"), 0))


def build(chunks: DataFrame, key: Column, text: Column, block: int = BLOCK) -> Index:
    """The index of ``chunks``; ``key`` is a column or struct that orders and names them."""
    # chunks are cut here: what a Python worker holds follows the rows of a batch
    with settings(chunks.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=str(BATCH)):
        rows = written(chunks.select(key.alias("key"), F.lower(F.coalesce(text, F.lit(""))).alias("text")), "chunks")
    blocks = F.lit(max(1, -(-rows.count() // block)))
    each = rows.select("key", F.pmod(F.xxhash64("key"), blocks).cast("int").alias("block"), F.explode(tokens(F.col("text"))).alias("token"))
    postings = written(each.groupBy("token", "block").agg(F.count(F.lit(1)).alias("n"), F.collect_list("key").alias("keys")), "postings")
    return Index(rows, postings, written(postings.groupBy("token").agg(F.sum("n").alias("n")), "vocabulary"))


def _grams(word: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word) - (LEAST - 1)), lambda i: F.substring(word, i, F.lit(LEAST))))


def _term_tokens(index: Index, terms: DataFrame) -> DataFrame:
    """(term, token, n) for the distinct terms: the tokens that contain each."""
    vocabulary = index.vocabulary.select("token", "n", F.explode(_grams(F.col("token"))).alias("gram"))
    asked = terms.select("term").distinct().withColumn("gram", F.substring("term", 1, LEAST))
    return asked.join(vocabulary, "gram").filter(F.contains("token", F.col("term"))).select("term", "token", "n")


def _scored(index: Index, wanted: DataFrame, by_term: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, key, score) of all chunks that hold one of the ``wanted`` (query_id, term)."""
    # per query each token once, so a block of its list is read once
    lists = wanted.join(by_term.select("term", "token"), "term").select("query_id", "token").distinct()
    found = lists.join(index.postings.select("token", "keys"), "token").select("query_id", F.explode("keys").alias("key")).distinct()
    hits = F.size(F.filter("terms", lambda t: F.contains(F.col("text"), t)))
    return found.join(index.chunks, "key").join(queries, "query_id").select("query_id", "key", hits.alias("score"))


def search(index: Index, queries: DataFrame, k: int = 12) -> DataFrame:
    """query_id, key, score, place: the ``k`` (1 to 12) best chunks of each of ``queries`` (query_id, terms: distinct, lower case, of letters and digits)."""
    k = max(1, min(12, k))
    asked = written(queries.select("query_id", F.filter("terms", lambda t: F.length(t) >= LEAST).alias("terms")), "queries")
    terms = asked.select("query_id", F.explode("terms").alias("term"))
    by_term = written(_term_tokens(index, terms), "terms")
    # the terms that occur at all, rarest first
    size = by_term.groupBy("term").agg(F.sum("n").alias("n"), F.max("n").alias("sure"))
    order = Window.partitionBy("query_id").orderBy("n", "term")
    ranked = terms.join(size, "term").withColumns({"r": F.row_number().over(order), "of": F.count(F.lit(1)).over(Window.partitionBy("query_id"))})
    # lists up to the first that alone has ``k`` chunks
    before = F.max("sure").over(order.rowsBetween(Window.unboundedPreceding, -1))
    ranked = written(ranked.withColumn("first", F.coalesce(before, F.lit(0)) < k), "ranked")
    opening = _scored(index, ranked.filter("first").select("query_id", "term"), by_term, asked)
    bound = top_k(opening, k, [F.desc("score"), F.col("key")], ["query_id"], "place").filter(F.col("place") == k).select("query_id", F.col("score").alias("bound"))
    needed = ranked.join(bound, "query_id", "left").filter(F.col("r") <= F.col("of") - F.coalesce("bound", F.lit(1)) + 1).select("query_id", "term")
    best = _scored(index, needed, by_term, asked)
    return top_k(best, k, [F.desc("score"), F.col("key")], ["query_id"], "place").select("query_id", "key", "score", F.col("place").cast("int").alias("place"))
