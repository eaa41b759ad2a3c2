"""Search by postings against scoring every chunk."""

import random

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import postings

rng = random.Random(4)
WORDS = ["".join(rng.choices("abcde", k=rng.randint(2, 6))) for _ in range(300)]
COMMON = ["the", "andy", "xthey"]


def made(n):
    return [(i // 3, i % 3, " ".join(rng.choices(WORDS, k=20) + rng.sample(COMMON, rng.randint(1, 3)))) for i in range(n)] + [(9000, 0, None), (9001, 0, ""), (9002, 0, "The, THE-andy é")] + [(9100 + i, 0, "copy the andy xthey") for i in range(n // 2)]


def plain(chunks, queries, k):
    out = set()
    for q, terms in queries:
        terms = [t for t in terms if len(t) >= 3]
        scored = sorted((-sum(t in (c or "").lower() for t in terms), (d, i)) for d, i, c in chunks)
        out |= {(q, *key, -s, p + 1) for p, (s, key) in enumerate(scored[:k]) if s < 0}
    return out


QUERIES = [(q, sorted(set(rng.choices(WORDS, k=6)) | set(COMMON[: q % 4]))) for q in range(40)] + [(40, []), (41, ["zzzzzz"]), (42, ["the"]), (43, ["he"]), (44, ["the", "andy", "xthey", "copy"]), (45, ["the", "zzzzzz", "9"])]


@pytest.mark.parametrize("k", [1, 5, 12])
@pytest.mark.parametrize("block", [50, 4096])
def test_equals_scoring_everything(spark, k, block):
    chunks = made(300)
    df = spark.createDataFrame(chunks, "doc_id long, chunk_index int, chunk string").repartition(3)
    queries = spark.createDataFrame(QUERIES, "query_id long, terms array<string>")
    index = postings.build(df, F.struct("doc_id", "chunk_index"), F.col("chunk"), block)
    got = {(r.query_id, *r.key, r.score, r.place) for r in postings.search(index, queries, k).collect()}
    assert got == plain(chunks, QUERIES, k)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, chunk string")
    queries = spark.createDataFrame(QUERIES, "query_id long, terms array<string>")
    assert postings.search(postings.build(df, F.col("doc_id"), F.col("chunk")), queries).count() == 0
    some = postings.build(spark.createDataFrame([(1, "the")], "doc_id long, chunk string"), F.col("doc_id"), F.col("chunk"))
    assert postings.search(some, queries.filter("false")).count() == 0
    assert [r.key for r in postings.search(some, queries.filter("query_id = 42"), 99).collect()] == [1]
