"""Joins by containment, pattern, overlap or place, against small fixed dimensions or within a key.

Dimensions here are constant tables of a few rows, so they are sent to every task; anything that grows
with the data joins by equality.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has, s, spaced_terms

# Government portals by what a query names.
PORTALS = [
    ("USA.gov official", "https://www.usa.gov/", r"(?i)\b(?:united states|usa|u\.s\.|american government)\b"),
    ("GOV.UK official", "https://www.gov.uk/", r"(?i)\b(?:united kingdom|uk|british government|england|scotland|wales)\b"),
    ("India.gov.in official", "https://www.india.gov.in/", r"(?i)\b(?:india|indian government|bharat)\b"),
    ("Canada.ca official", "https://www.canada.ca/", r"(?i)\b(?:canada|canadian government)\b"),
    ("Australia.gov.au official", "https://www.australia.gov.au/", r"(?i)\b(?:australia|australian government)\b"),
    ("Gouvernement.fr official", "https://www.gouvernement.fr/", r"(?i)\b(?:france|french government)\b"),
    ("Bundesregierung official", "https://www.bundesregierung.de/", r"(?i)\b(?:germany|german government|deutschland)\b"),
    ("Japan government official", "https://www.japan.go.jp/", r"(?i)\b(?:japan|japanese government)\b"),
    ("Singapore government official", "https://www.gov.sg/", r"(?i)\b(?:singapore|singapore government)\b"),
    ("South African Government official", "https://www.gov.za/", r"(?i)\b(?:south africa|south african government)\b"),
    ("European Union official", "https://european-union.europa.eu/", r"(?i)\b(?:european union|eu commission|eu parliament|eu\b)\b"),
    ("United Nations official", "https://www.un.org/", r"(?i)\b(?:united nations|un\b)\b"),
]


def portals(x: Column) -> Column:
    """array(struct(label, url)) of the portals a query names: the pattern join against a constant table, as one expression with literal patterns."""
    row = lambda label, url, p: F.when(has(s(x), p), F.struct(F.lit(label).alias("label"), F.lit(url).alias("url")))
    return F.array_compact(F.array(*[row(*p) for p in PORTALS]))


def lookup(x: Column, dimension: list[tuple[str, str]]) -> Column:
    """Value of the first entry whose word stands in the text, in the dimension's order; null without one."""
    return F.coalesce(*[F.when(has(F.lower(s(x)), rf"\b(?:{word})\b"), F.lit(value)) for word, value in dimension])


# Coins by name.
COINS = [("bitcoin|btc", "bitcoin"), ("ethereum|eth", "ethereum"), ("solana|sol", "solana"), ("dogecoin|doge", "dogecoin")]


def best_overlap(messages: DataFrame, threads: DataFrame, key: str, message: str, topic: str, order: str, stop: list[str], id_col: str) -> DataFrame:
    """messages with ``best``: the thread (of the same key) that shares most tokens, the first of equals; null without any.

    ``id_col`` names the messages. Tokens of the message count as often as they stand there.
    """
    m = messages.withColumn("_w", spaced_terms(F.col(message), stop, 24, distinct=False))
    t = threads.select(key, F.col(order).alias("_o"), F.col(topic).alias("_topic"), spaced_terms(F.col(topic), stop, 24, distinct=False).alias("_t"))
    pairs = m.join(t, key).withColumn("_n", F.size(F.filter("_w", lambda w: F.array_contains(F.col("_t"), w))))
    best = pairs.filter("_n > 0").groupBy(id_col).agg(F.max_by("_topic", F.struct("_n", -F.col("_o"))).alias("best"))
    return m.join(best, id_col, "left").drop("_w")


def semi_or_all(rows: DataFrame, keys: DataFrame, key: str, by: str) -> DataFrame:
    """Per group ``by`` the rows whose key is among the group's keys; all of the group's rows where none is."""
    marked = rows.join(keys.select(by, key).distinct().withColumn("_hit", F.lit(True)), [by, key], "left")
    any_ = marked.groupBy(by).agg(F.max(F.coalesce("_hit", F.lit(False))).alias("_any"))
    return marked.join(any_, by).filter(F.coalesce("_hit", F.lit(False)) | ~F.col("_any")).drop("_hit", "_any")


def select_by_index(rows: DataFrame, picks: DataFrame, by: str, index: str, order: str, url: str, strong: Column, most: int = 3) -> DataFrame:
    """Rows at the picked places (each URL once, in the order of the picks); where none fits, the first strong rows."""
    from pyspark.sql import Window

    at = picks.select(by, index, F.col(order).alias("_p")).join(rows, [by, index]).filter(s(F.col(url)) != "")
    once = at.withColumn("_r", F.row_number().over(Window.partitionBy(by, url).orderBy("_p"))).filter("_r = 1").drop("_r")
    rest = rows.join(once.select(by).distinct(), by, "left_anti").filter(strong)
    rest = rest.withColumn("_p", F.row_number().over(Window.partitionBy(by).orderBy(index))).filter(F.col("_p") <= most)
    return once.unionByName(rest.select(once.columns)).withColumnRenamed("_p", "place")


def forget(memory: DataFrame, key: Column, name: str = "key", by: str = "user_id") -> DataFrame:
    """Memory without the entry that a key names: equal in any case, else the first that holds it or is held by it."""
    from pyspark.sql import Window

    wanted = F.lower(F.trim(s(key)))
    low = F.lower(s(F.col(name)))
    grade = F.when(wanted == "", F.lit(None)).when(low == wanted, 0).when(F.contains(low, wanted) | F.contains(wanted, low), 1)
    graded = memory.withColumn("_g", grade)
    first = F.row_number().over(Window.partitionBy(by).orderBy(F.col("_g").asc_nulls_last(), name))
    return graded.withColumn("_r", first).filter(~((F.col("_r") == 1) & F.col("_g").isNotNull())).drop("_g", "_r")


def concatenated(rows: DataFrame, by: str, order: str, line: Column, glue: str = "\n", most: int = 6) -> DataFrame:
    """by, block: the first lines of a group in order, joined."""
    from pyspark.sql import Window

    top = rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter(F.col("_r") <= most)
    agg = top.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_r", line.alias("x")))).alias("xs"))
    return agg.select(by, F.array_join(F.transform("xs", lambda v: v["x"]), glue).alias("block"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
