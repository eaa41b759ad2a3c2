"""Quality classifier: kernel ridge regression on document statistics by random Fourier features.

1. ``statistics``: a fixed vector of statistics per whole text (length, character classes, word and line
   shape, repetition). Nothing but the text enters.
2. Standardised statistics pass through ``cos(Wx + b)``, W normal, b uniform (fixed seed): inner products
   of these features approximate a Gaussian kernel.
3. Each partition sums its part of the normal equations (Z'Z, Z'y) per fold; partial sums are added in two
   levels, so the driver gets at most about the square root of the partition count of them, each of
   ``n_features^2`` numbers whatever the number of rows.
4. The folds' sums add up, so models that leave one fold out come without another pass; their scores on
   the fold left out fit an isotonic calibration (pool adjacent violators over ``n_bins`` score bins).

Every labelled training row takes part; no sampling. Labels are read only for ids whose
``crc32(id) mod 5`` is not 0. Scores use neither id, language nor source.

Defined cases: null text is empty and is scored like any text; a null id is never a training row and is
not held out; several labels of one id count as the smallest (a row once marked bad is bad); without any
training label all scores are 0.5; rows that repeat an id are scored each on its text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, text_of

N_FEATURES = 256
GAMMA = 0.08
RIDGE = 1e-3
N_BINS = 512
THRESHOLD = 0.3
SEED = 20240229

#: Character classes that are counted, by code point.
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
for _c in "#*$%&|<>":
    _CLASS[ord(_c)] = 4
for _c in ".,;:!?'\"()-":
    _CLASS[ord(_c)] = 5
for _c in " \t\n\r\v\f":
    _CLASS[ord(_c)] = 6
_CLASS[128:] = 7

STATS = [
    "log_chars", "lower", "upper", "digit", "symbol", "punct", "space", "other", "bang", "bar", "log_words", "word_len", "word_len_sd",
    "distinct_words", "distinct_pairs", "same_as_last", "top_word", "upper_words", "long_words", "log_lines", "distinct_lines", "words_per_line", "stops", "entropy",
]


def statistics(text: str) -> list[float]:
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    n = max(1, len(raw))
    by_byte = np.bincount(raw, minlength=256)
    kinds = np.bincount(_CLASS, weights=by_byte, minlength=8) / n
    words = text.split()
    w = max(1, len(words))
    counts: dict[str, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    lens = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    pairs = len(set(zip(words, words[1:], strict=False)))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = [x for x in text.split("\n") if x.strip()]
    p = by_byte[by_byte > 0] / n
    return [
        math.log1p(len(raw)), *kinds[1:8], by_byte[33] / n * 20, by_byte[124] / n * 20, math.log1p(len(words)), lens.mean(), lens.std(),
        len(counts) / w, pairs / w, same / w, max(counts.values(), default=0) / w, sum(map(str.isupper, words)) / w, float((lens > 12).mean()),
        math.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), math.log1p(w / max(1, len(lines))), by_byte[46] / w, float(-(p * np.log(p)).sum()),
    ]


def featurize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, x: the statistics of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "x": [statistics(t) for t in pdf["t"]]})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t")).mapInPandas(run, "doc_id long, x array<double>")


def fold_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


class Fourier:
    """Standardise, then random Fourier features with a constant."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray, n_features: int = N_FEATURES, gamma: float = GAMMA, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.sd = mean, np.where(sd > 1e-9, sd, 1.0)
        self.w = rng.normal(0.0, math.sqrt(2 * gamma), (len(mean), n_features))
        self.b = rng.uniform(0, 2 * math.pi, n_features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        u = np.clip((x - self.mean) / self.sd, -6, 6)
        z = np.cos(u @ self.w + self.b) * math.sqrt(2 / len(self.b))
        return np.hstack([z, np.ones((len(x), 1))])


def _sums(rows: DataFrame, fourier: Fourier) -> np.ndarray:
    """Per fold 1 to 4 the sums of [Z y]'[Z y]; shape (4, D + 1, D + 1)."""
    d = len(fourier.b) + 2

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((4, d, d))
        for pdf in batches:
            if len(pdf):
                z = np.hstack([fourier(np.stack(pdf["x"])), pdf[["y"]].to_numpy(dtype=np.float64)])
                fold = pdf["fold"].to_numpy()
                for k in range(1, 5):
                    total[k - 1] += z[fold == k].T @ z[fold == k]
        yield pd.DataFrame({"s": [total.tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, any_ = np.zeros((4, d, d)), False
        for pdf in batches:
            for s in pdf["s"]:
                total += np.frombuffer(s).reshape(4, d, d)
                any_ = True
        if any_:
            yield pd.DataFrame({"s": [total.tobytes()]})

    partial = rows.mapInPandas(part, "s binary")
    groups = max(1, math.isqrt(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    merged = partial.repartition(groups).mapInPandas(add, "s binary").collect()
    return sum((np.frombuffer(r.s).reshape(4, d, d) for r in merged), np.zeros((4, d, d)))


def _solve(sums: np.ndarray, ridge: float) -> np.ndarray:
    n = max(1.0, sums[-2, -2])
    a = sums[:-1, :-1] / n
    penalty = ridge * np.eye(len(a))
    penalty[-1, -1] = 0
    return np.linalg.lstsq(a + penalty, sums[:-1, -1] / n, rcond=None)[0]


def isotonic(weight: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the nearest non-decreasing values."""
    stack: list[list[float]] = []
    for w, m in zip(weight, mean, strict=True):
        stack.append([w, m, 1])
        while len(stack) > 1 and stack[-2][1] >= stack[-1][1]:
            w2, m2, k2 = stack.pop()
            w1, m1, k1 = stack.pop()
            stack.append([w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), k1 + k2])
    return np.concatenate([np.full(int(k), m) for _, m, k in stack]) if stack else np.zeros(0)


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, ridge: float = RIDGE, n_bins: int = N_BINS) -> DataFrame:
    """doc_id, held_out, score, predicted, raw_score: one row per document."""
    stats = stage(featurize(docs, id_col, text_col), "stats")
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).filter("y IS NOT NULL")
    marks = marks.withColumn("fold", fold_of(F.col("doc_id"))).filter("fold > 0").groupBy("doc_id", "fold").agg(F.min("y").alias("y"))
    train = stage(stats.join(marks, "doc_id").select("x", "y", F.col("fold").cast("int").alias("fold")), "train")
    k = len(STATS)
    aggs = [F.count(F.lit(1)).alias("n")] + [f(F.col("x")[i]).alias(f"{n}{i}") for i in range(k) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    head = train.agg(*aggs).first()
    held = F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    if not head["n"]:
        return stats.select("doc_id", held, F.lit(0.5).alias("score"), F.lit(int(threshold <= 0.5)).alias("predicted"), F.lit(0.5).alias("raw_score"))
    fourier = Fourier(np.array([head[f"m{i}"] for i in range(k)]), np.array([head[f"s{i}"] for i in range(k)]))
    sums = _sums(train, fourier)
    full = _solve(sums.sum(axis=0), ridge)
    without = np.stack([_solve(sums.sum(axis=0) - sums[i], ridge) if sums.sum(axis=0)[-2, -2] > sums[i][-2, -2] else full for i in range(4)])

    def to_bin(raw: np.ndarray) -> np.ndarray:
        return np.clip(((raw + 0.5) / 2 * n_bins).astype(int), 0, n_bins - 1)

    def left_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f, w = fourier, without
        n, pos = np.zeros(n_bins), np.zeros(n_bins)
        for pdf in batches:
            if len(pdf):
                raw = (f(np.stack(pdf["x"])) * w[pdf["fold"].to_numpy() - 1]).sum(axis=1)
                np.add.at(n, b := to_bin(raw), 1)
                np.add.at(pos, b, pdf["y"].to_numpy())
        at = np.flatnonzero(n)
        yield pd.DataFrame({"b": at, "n": n[at], "pos": pos[at]})

    curve = train.mapInPandas(left_out, "b int, n double, pos double").groupBy("b").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).toPandas().sort_values("b")
    mid = (curve["b"].to_numpy() + 0.5) / n_bins * 2 - 0.5
    level = isotonic(curve["n"].to_numpy(), curve["pos"].to_numpy() / curve["n"].to_numpy())
    level = np.clip(level, 0, 1)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = fourier(np.stack(pdf["x"])) @ full if len(pdf) else np.zeros(0)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "raw_score": raw, "score": np.interp(raw, mid, level)})

    out = stats.mapInPandas(score, "doc_id long, raw_score double, score double")
    return out.select("doc_id", held, "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "raw_score")
