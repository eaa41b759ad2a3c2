"""Exact deduplication, DataFrame functions only.

Texts are compared after white-space runs become one space. The work goes through three combining
stages, and each groups by the *content* beside its digest, so equal digests alone never merge texts:

1. inside a map task (the partial aggregate of stage 2),
2. over (digest, salt, content): a hot group is spread over ``n_salts`` reducers,
3. over (digest, content): at most ``n_salts`` salt winners of a group are left.

The verdict returns to the rows over the thin key (digest, second digest, salt), never over a bare hot
key, and no text moves on that way.

Defined cases: null text is the empty text; a null id sorts before nothing (it never wins over a real
id) and still gets its row; rows that repeat an id count as separate copies and carry the same verdict;
an empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, salts, text_of


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_salts: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row."""
    n = n_salts or salts(docs.sparkSession)
    norm = F.regexp_replace(text_of(text_col), WS + "+", " ")
    rows = docs.select(F.col(id_col).alias("id"), norm.alias("content")).select(
        "id", "content", F.sha2("content", 256).alias("d"), F.xxhash64("content").alias("x"), F.pmod(F.xxhash64("id"), F.lit(n)).alias("s")
    )
    salted = rows.groupBy("d", "x", "s", "content").agg(F.min("id").alias("k"), F.count(F.lit(1)).alias("n"))
    winners = salted.groupBy("d", "x", "content").agg(F.min("k").alias("keep_id"), F.sum("n").alias("group_size"))
    back = rows.select("d", "x", "s").distinct().join(winners.select("d", "x", "keep_id", "group_size"), ["d", "x"])
    out = rows.drop("content").join(back, ["d", "x", "s"])
    return out.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.col("d").alias("text_sha256"),
    )


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM n JOIN g USING (t)
"""
