"""Windows over conversation turns: compaction, budgets, anchors, search in memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, has, s, topic_terms, trim


def speaker(role: Column) -> Column:
    """Anything but a user speaks as the assistant."""
    return F.when(role == "user", "User").otherwise("Assistant")


def compact(turns: DataFrame, recent: int = 10, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """conv_id, block: the last turns word for word, older ones as a digest of one line each."""
    w = Window.partitionBy(key)
    rows = turns.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc(order))))
    clean = collapse(F.col("text"))
    short = F.when(F.length(clean) > 200, F.concat(F.substring(clean, 1, 195), F.lit("…"))).otherwise(clean)
    said = F.concat(speaker(F.col("role")), F.lit(": "), s(F.col("text")))
    old = F.col("_r") > recent
    agg = rows.groupBy(key).agg(
        F.max("_n").alias("n"),
        F.array_sort(F.collect_list(F.when(old & (clean != ""), F.struct(F.col(order).alias("o"), F.concat(F.lit("- "), speaker(F.col("role")), F.lit(": "), short).alias("x"))))).alias("a"),
        F.array_sort(F.collect_list(F.when(~old, F.struct(F.col(order).alias("o"), said.alias("x"))))).alias("b"),
    )
    lines = lambda c: F.array_join(F.transform(c, lambda x: x["x"]), "\n")
    head = F.when(
        F.size("a") > 0, F.concat(F.lit("[Previous Conversation Digest ("), (F.col("n") - recent).cast("string"), F.lit(" earlier turns):\n"), lines(F.col("a")), F.lit("]\n\n"))
    ).otherwise("")
    return agg.select(key, F.concat(head, lines(F.col("b"))).alias("block"))


def char_budget(turns: DataFrame, max_turns: int = 12, max_chars: int = 9000, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Newest turns while their lengths (plus 20 each) fit; the newest always stays."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    rows = turns.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max_turns)
    rows = rows.withColumn("_c", F.sum(F.length(s(F.col("text"))) + 20).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter((F.col("_r") == 1) | (F.col("_c") <= max_chars)).drop("_r", "_c")


def clip_budget(turns: DataFrame, last: int = 12, each: int = 3000, total: int = 9000, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last turns, each and all together clipped; the turn that crosses the total is cut."""
    back = Window.partitionBy(key).orderBy(F.desc(order))
    ahead = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.withColumn("_r", F.row_number().over(back)).filter(F.col("_r") <= last).withColumn("text", F.substring(trim(F.col("text")), 1, each))
    rows = rows.withColumn("_b", F.coalesce(F.sum(F.length("text")).over(ahead), F.lit(0)))
    rows = rows.withColumn("text", F.expr(f"substring(text, 1, greatest(0, {total} - _b))"))
    return rows.filter(F.length("text") > 0).drop("_r", "_b")


UNDERSPECIFIED = r"\b(it|its|they|them|that|this|these|those|there|same|above|earlier|previous|first match|opening match|that match|that game|who are playing|who is playing)\b"
QUESTION_LEAD = r"^(who|what|when|where|which|how)\b"
INTRODUCTION = r"(?i)^(?:tell me about|explain|define|what is|who is)\s+\S+"


def topic_anchor(turns: DataFrame, last: int = 8, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """conv_id, anchor: terms of the latest user turn (of the last eight) that says what it is about."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    rows = turns.filter(F.lower("role") == "user").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= last)
    t = trim(F.col("text"))
    rows = rows.withColumn("_t", t).filter("_t <> ''").withColumn("_w", topic_terms(F.col("_t")))
    n, low = F.size("_w"), F.lower("_t")
    strong = (n == 1) & (F.length(F.col("_w")[0]) >= 4)
    vague = has(low, UNDERSPECIFIED) | ((n > 0) & (n <= 3)) | (has(low, QUESTION_LEAD) & (n <= 4))
    told = (n > 0) & has(F.col("_t"), INTRODUCTION)
    good = (n > 0) & ((n >= 2) | strong) & (~vague | strong | told)
    picked = rows.filter(good).groupBy(key).agg(F.max_by(F.array_join(F.slice("_w", 1, 8), " "), order).alias("anchor"))
    return turns.select(key).distinct().join(picked, key, "left").select(key, F.coalesce("anchor", F.lit("")).alias("anchor"))


def memory_search(turns: DataFrame, query: str, most: int = 4, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The first turns of each conversation that hold any query word of three letters or more."""
    words = [t for t in query.lower().split() if len(t) >= 3]
    low = F.lower(s(F.col("text")))
    hit = F.lit(False)
    for t in words:
        hit = hit | F.contains(low, F.lit(t))
    w = Window.partitionBy(key).orderBy(order)
    rows = turns.filter(hit).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)
    text = s(F.col("text"))
    return rows.withColumn("snippet", F.when(F.length(text) > 300, F.concat(F.substring(text, 1, 300), F.lit("..."))).otherwise(text))


def last_k(df: DataFrame, k: int, by: str, order: list[Column]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")
