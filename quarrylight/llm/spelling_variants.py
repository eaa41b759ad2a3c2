r"""Spelling variant grouping by a symmetric-delete join.

Words are the lower-cased (A-Z only) runs ``[A-Za-zÀ-ÿ]+``. So that spelling variants exist in clean text, a run whose checksum
with its document's id is a multiple of ``noise`` loses one letter (``noise=None``: no run does). Words of ``min_length`` code points and
``min_count`` occurrences are counted map-side first, so a word that fills a third of the corpus is one row a task.

Every word emits itself and its distinct single deletions. Two words at distance one meet under exactly one emitted string:

* one letter more or less: the shorter word itself, a deletion of the longer one;
* one letter replaced: both words without that letter. Deletions inside a run of equal letters are one string and are emitted once,
  from the run's start, so no pair meets twice and none is counted twice.

Rows meet on a 64-bit hash of that string. The strings themselves and the distance are compared afterwards. At most 90 letters a place share
a deletion, so a group under one string has at most ``90 * (length + 1)`` words however large the corpus is.

Words above ``long`` code points would carry their length in each of as many rows. They emit rolling hashes of their deletions and a
digest instead (``_long_keys``), and meet their text again for the same exact comparison.

A word's form is its near word of largest count if that is ``ratio`` times its own. Counts rise along forms, so following them ends;
each round joins every root with its own root, which halves what is left of a chain.

Defined cases: null text has no words; a null id is the empty string in the checksum; rows that repeat count as often as they stand there;
words of any length are compared; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, text_of, unstage

LETTERS = r"[A-Za-zÀ-ÿ]"
MIN_LENGTH = 7
MIN_COUNT = 2
NOISE = 31
RATIO = 10
LONG = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Two moduli and a base of the rolling hashes of long words.
_MODULI, _BASE = ((1 << 61) - 1, (1 << 59) - 55), 1_000_003


def without(word: Column, place: Column) -> Column:
    """``word`` without the code point at ``place`` (from 1); all of it at 0."""
    return F.when(place == 0, word).otherwise(F.concat(F.substring(word, F.lit(1), place - 1), F.substring(word, place + 1, F.length(word))))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, noise: int | None = NOISE) -> DataFrame:
    """(word, n): the distinct words of at least ``min_length`` code points that occur ``min_count`` times or more."""
    found = F.regexp_extract_all(text_of(text_col), F.lit(f"{LETTERS}{{{max(min_length, 1)},}}"), 0)
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run")).select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    if noise:
        hit = rows.select("run", F.crc32(F.concat_ws(":", "id", "run")).alias("h"))
        place = (F.col("h") % F.length("run") + 1).cast("int")
        rows = hit.select(F.when(F.col("h") % noise == 0, without(F.col("run"), place)).otherwise(F.col("run")).alias("run")).filter(F.length("run") >= min_length)
    return rows.groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def _places(word: Column) -> Column:
    """0 for the word itself, then the start of each run of equal letters."""
    starts = F.filter(F.sequence(F.lit(1), F.length(word)), lambda i: (i == 1) | (F.substring(word, i, F.lit(1)) != F.substring(word, i - 1, F.lit(1))))
    return F.concat(F.array(F.lit(0)), starts)


def _short_pairs(words: DataFrame) -> DataFrame:
    """(word, other, other_n), both ways, of words that may carry themselves in each row."""
    keys = words.select("word", "n", F.explode(_places(F.col("word"))).alias("p")).select(F.xxhash64(without(F.col("word"), F.col("p"))).alias("h"), "word", "n", "p")
    a, b = keys.alias("a"), keys.alias("b")
    met = a.join(b, F.expr("a.h = b.h AND a.word != b.word AND levenshtein(a.word, b.word, 1) = 1"))
    return met.filter(without(F.col("a.word"), F.col("a.p")) == without(F.col("b.word"), F.col("b.p"))).select(F.col("a.word"), F.col("b.word").alias("other"), F.col("b.n").alias("other_n"))


def _long_keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(h1, h2, word_id): rolling hashes of each word and its distinct deletions, in time linear in the word."""
    for frame in frames:
        for word_id, word in zip(frame["word_id"], frame["word"], strict=True):
            places = [-1] + [i for i in range(len(word)) if i == 0 or word[i] != word[i - 1]]
            columns = []
            for m in _MODULI:
                head = [0]
                for c in word:
                    head.append((head[-1] * _BASE + ord(c)) % m)
                whole, tail, power, by_place = head[-1], 0, 1, [0] * len(word)
                for i in range(len(word) - 1, -1, -1):
                    by_place[i] = (head[i] * power + tail) % m
                    tail, power = (tail + ord(word[i]) * power) % m, power * _BASE % m
                columns.append([whole if i < 0 else by_place[i] for i in places])
            for at in range(0, len(places), 50_000):
                h1, h2 = (c[at : at + 50_000] for c in columns)
                yield pd.DataFrame({"h1": h1, "h2": h2, "word_id": word_id})


def _long_pairs(words: DataFrame, long: int) -> DataFrame:
    """(word, other, other_n), both ways, of pairs with a word above ``long`` code points."""
    held = words.filter(F.length("word") >= long).withColumn("word_id", F.sha2("word", 256))
    keys = held.select("word_id", "word").mapInPandas(_long_keys, "h1 long, h2 long, word_id string")
    a, b = keys.alias("a"), keys.alias("b")
    met = a.join(b, F.expr("a.h1 = b.h1 AND a.h2 = b.h2 AND a.word_id != b.word_id")).select(F.col("a.word_id"), F.col("b.word_id").alias("other_id")).distinct()
    other = held.select(F.col("word_id").alias("other_id"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    return met.join(held.select("word_id", "word"), "word_id").join(other, "other_id").filter(
        F.expr(f"greatest(length(word), length(other)) > {long} AND levenshtein(word, other, 1) = 1")
    ).select("word", "other", "other_n")


def near_pairs(words: DataFrame, long: int = LONG) -> DataFrame:
    """(word, other, other_n): every pair at distance exactly one among the distinct ``words`` (word, n), in both directions."""
    return _short_pairs(words.filter(F.length("word") <= long)).unionByName(_long_pairs(words, long))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every row of ``forms`` (word, form): the last form along the chain. Forms have to rise in some order."""
    now = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("above"))
        new = stage(now.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        moved = not new.filter("moved").isEmpty()
        unstage(now)
        now = new
        if not moved:
            return now.drop("moved")


def spelling_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    noise: int | None = NOISE,
    ratio: int = RATIO,
    long: int = LONG,
) -> DataFrame:
    """word, n, n_near, form, form_n, root: one row per word."""
    words = stage(word_counts(docs, id_col, text_col, min_length, min_count, noise), "words")
    near = near_pairs(words, long).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best"))
    top = -F.col("best.less")
    is_form = top >= ratio * F.col("n")
    judged = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, top).cast("long").alias("form_n")
    )
    judged = stage(judged, "forms")
    unstage(words)
    return judged.join(roots(judged.filter("form IS NOT NULL")), "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")
    )


#: The same rows. Words of unequal length that share a string are near; those of equal length where one place differs. The checksum is spelled out; runs hold no code point above U+00FF, so UTF-8 takes one or two bytes of each.
SQL = r"""
WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
d AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY id, run),
h AS (SELECT run, n, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(id || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [CAST(192 + (ord(x) >> 6) AS BIGINT), CAST(128 + (ord(x) & 63) AS BIGINT)] END))),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM d, tab),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
keys AS (SELECT DISTINCT word, n, k FROM (SELECT word, n, unnest(list_concat([word], list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i - 1) || substr(word, i + 1)))) AS k FROM w)),
pairs AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM keys a JOIN keys b ON a.k = b.k AND a.word != b.word
  WHERE length(a.word) != length(b.word) OR len(list_filter(list_zip(string_split(a.word, ''), string_split(b.word, '')), lambda x: x[1] != x[2])) = 1),
best AS (SELECT word, n, other, other_n, count(*) OVER (PARTITION BY word) AS n_near FROM pairs QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) = 1),
forms AS (SELECT word, n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n FROM best),
up AS (SELECT word, form AS root, 1 AS k FROM forms WHERE form IS NOT NULL UNION ALL SELECT up.word, forms.form, k + 1 FROM up JOIN forms ON up.root = forms.word WHERE forms.form IS NOT NULL),
last AS (SELECT word, arg_max(root, k) AS root FROM up GROUP BY word)
SELECT w.word, w.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, form, form_n, coalesce(root, w.word) AS root FROM w LEFT JOIN forms USING (word) LEFT JOIN last USING (word)
"""
