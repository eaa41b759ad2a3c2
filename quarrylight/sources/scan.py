"""Scans of source trees for patterns: rules against files, with an allow-list and line numbers; unchanged files are skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_words, s

SKIP = r"(?:^|/)(?:node_modules|\.git|dist|build|coverage)(?:/|$)"  # fixed value: folders without own sources
ENDINGS = (".js", ".mjs", ".ts", ".json", ".html", ".css", ".md", ".py")


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """path, text, hash of the text files below a folder."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    kept = df.filter(~F.col("path").rlike(SKIP) & F.col("path").rlike(r"(?:" + "|".join(e.replace(".", r"\.") for e in ENDINGS) + ")$"))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return kept.select("path", text.alias("text"), F.sha2(F.col("content"), 256).alias("hash"))


def line_of(text: Column, at: Column) -> Column:
    """Number of the line in which the character at a place (from 1) stands."""
    return F.size(F.split(F.substring(text, F.lit(1), at - 1), r"\r?\n"))


def scan(files: DataFrame, rules: list[tuple[str, str, str]], allowed: list[str] | None = None) -> DataFrame:
    """path, category, reason, found, line: the first place of each rule's pattern in each file, allowed ones left out."""

    def finding(category: str, reason: str, pattern: str) -> Column:
        p = ascii_words(pattern)
        at = F.regexp_instr(F.col("text"), F.lit(p))
        found = F.regexp_extract(F.col("text"), p, 0)
        clean = F.lit(True)
        for a in allowed or []:
            clean = clean & ~found.rlike(f"(?i){a}")
        return F.when((at > 0) & clean, F.struct(F.lit(category).alias("category"), F.lit(reason).alias("reason"), found.alias("found"), line_of(F.col("text"), at).alias("line")))

    hits = files.select("path", F.explode(F.array_compact(F.array(*[finding(*r) for r in rules]))).alias("f"))
    return hits.select("path", "f.category", "f.reason", "f.found", "f.line")


def changed(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Files whose path and hash are not among those seen before."""
    return files.join(seen.select("path", "hash"), ["path", "hash"], "left_anti")


def totals(files: DataFrame, fresh: DataFrame, findings: DataFrame) -> DataFrame:
    """files, cached, findings."""
    a = files.agg(F.count(F.lit(1)).alias("files"))
    b = fresh.agg(F.count(F.lit(1)).alias("fresh"))
    c = findings.agg(F.count(F.lit(1)).alias("findings"))
    return a.join(b).join(c).select("files", (F.col("files") - F.col("fresh")).alias("cached"), "findings")


def names(x: Column) -> Column:
    """Distinct runs of two to six capitalised words."""
    return F.array_distinct(F.regexp_extract_all(s(x), F.lit(ascii_words(r"\b([A-Z][A-Za-z0-9]*(?:\s+[A-Z][A-Za-z0-9]*){1,5})\b")), 1))


def string_literals(x: Column) -> Column:
    """Contents of quoted strings in code, escapes kept."""
    quoted = r""""((?:\\.|[^"\\\n])*+)"|'((?:\\.|[^'\\\n])*+)'|`((?:\\.|[^`\\])*+)`"""
    whole = F.regexp_extract_all(s(x), F.lit(quoted), 0)
    return F.transform(whole, lambda v: F.substring(v, F.lit(2), F.length(v) - 2))
