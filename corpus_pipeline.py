"""The corpus pipeline: quality rules, exact dedup, near-dedup, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return
the columns of ``documents``. ``run`` writes each stage's rows to the shared folder and reads them again.

Defined cases, of every stage: a null text is empty (the rules reject it; the later stages keep such a row, and
packing gives it one piece); a null source is a host of its own; rows without a doc_id are documents like others: they count as
larger than every id, so they go where a document with an id has their text or nearly so, and of several of them one stays; rows that repeat a
doc_id are rows of their own to the rules and the passages, exact dedup keeps one row of an id and text, and near dedup keeps or drops them
together; an empty table gives an empty one; columns beside those of ``documents`` are dropped, whatever their names.

A stage deletes what it staged, but for the tables that its result reads. These go with the application; ``run`` deletes them once
the result is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import exact_dedup, minhash_join, packing, quality_rules, suffix_dedup
from quarrylight.llm.common import WS, stage, text_of, unstage, watched
from quarrylight.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Step = Callable[[SparkSession, DataFrame, str], DataFrame]


def only(make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """What ``make`` gives, staged; all that was staged on the way is deleted."""
    with watched() as mine:
        out = stage(make(), tag)
    unstage(*(t for t in list(mine) if t is not out))
    return out


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; boilerplate lines go from the rest."""
    # staged before the filter: pushed below the join, the filter would take the counts' expressions apart and repeat them
    judged = only(lambda: quality_rules.quality_rules(docs, carry=("lang", "source"), clean=True).select("doc_id", "kept", "clean_text", "in_lang", "in_source"), "judged").filter("kept")
    return judged.select("doc_id", F.col("clean_text").alias("text"), F.col("in_lang").alias("lang"), F.col("in_source").alias("source"), F.length("clean_text").cast("long").alias("n_chars"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays, once."""
    # staged, so the exchanges of the verdict are gone when the texts cross the network once more
    kept = only(lambda: exact_dedup.exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_kept")).distinct(), "kept")
    marked = docs.select(*COLUMNS).withColumn("_sha", F.sha2(F.regexp_replace(text_of("text"), WS + "+", " "), 256))
    return marked.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("_kept")), "left_semi").dropDuplicates(["doc_id", "_sha"]).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    # a row without an id gets one that is larger than ids are, the same one whenever it is read
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.xxhash64(text_of("text")).bitwiseAND(F.lit((1 << 61) - 1)))
    keyed = docs.select(*COLUMNS).withColumn("_key", key)
    kept = only(lambda: minhash_join.near_duplicates(keyed, "_key").filter("kept").select(F.col("doc_id").alias("_key")).distinct(), "kept")
    rows = keyed.join(kept, "_key", "left_semi")
    # rows without an id that have the same text share a key; one of them stays
    return rows.filter("doc_id IS NOT NULL").unionByName(rows.filter("doc_id IS NULL").dropDuplicates(["_key"])).select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of repeated 400-byte strings go; a document that loses all of its text stays as an empty one."""
    cut = suffix_dedup.suffix_dedup(docs, with_text=True, carry=("lang", "source"))
    return cut.select("doc_id", F.col("kept_text").alias("text"), F.col("in_lang").alias("lang"), F.col("in_source").alias("source"), F.length("kept_text").cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return packing.best_fit_packing(docs, tokenizer_path())


STAGES = [("quality_rules", rules), ("exact_dedup", exact), ("minhash_near_dedup", near), ("suffix_array_dedup", passages), ("best_fit_packing", packed)]

#: Connected components and suffix arrays have no SQL form; the tests hold ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, step in STAGES[:-1]:
        with watched() as mine:
            docs = stage(step(spark, docs, sf_dir), name)
        read = [t for t in mine if t is docs]
        # the stage's result is written, so what it read is done with, and so is the result before
        unstage(*before, *(t for t in list(mine) if t is not docs))
        before = read
    return STAGES[-1][1](spark, docs, sf_dir)
