"""The quality classifier end to end against a plain version: direct ridge solutions, fold by fold, and isotonic levels by their min-max formula."""

import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from quarrylight.llm import quality_classifier as q

r = random.Random(21)
WORDS = ["".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(200)]


def text(good):
    words = r.choices(WORDS, k=r.randint(5, 120))
    return " ".join(words) + "." if good else "!! ".join(w.upper() for w in words[: max(3, len(words) // 4)] * 2)


ROWS = [(i, text(good := r.random() < 0.7), int(good) if r.random() < 0.93 else int(not good)) for i in range(200)]
ODD = [(900, None), (901, ""), (902, " \n\t"), (None, "an id is missing"), (3, ROWS[3][1]), (3, "another text of a repeated id"), (903, "long " * 200_000)]


def minmax(weight, mean):
    """Isotonic regression: of all blocks that end at or after i, the least mean; of those that start at or before, the greatest."""
    n = len(mean)
    block = lambda j, k: np.average(mean[j : k + 1], weights=weight[j : k + 1])
    return np.array([max(min(block(j, k) for k in range(i, n)) for j in range(i + 1)) for i in range(n)])


def plain(docs, labels, gamma=q.GAMMA, ridge=q.RIDGE, bins=q.N_BINS):
    stat = {i: np.array(q.statistics(t or "")) for i, t in enumerate(t for _, t in docs)}
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    y_of = {}
    for i, y in labels:
        if y is not None and i is not None and fold(i):
            y_of[i] = min(y, y_of.get(i, y))
    train = [(k, i) for k, (i, _) in enumerate(docs) if i in y_of]
    x, y, f = np.array([stat[k] for k, _ in train]), np.array([float(y_of[i]) for _, i in train]), np.array([fold(i) for _, i in train])
    sd = x.std(axis=0)
    rng = np.random.default_rng(q.SEED)
    w = rng.normal(0, math.sqrt(2 * gamma), (x.shape[1], q.N_FEATURES))
    b = rng.uniform(0, 2 * math.pi, q.N_FEATURES)

    def features(rows):
        u = np.clip((rows - x.mean(axis=0)) / np.where(sd > 1e-9, sd, 1), -6, 6)
        return np.hstack([math.sqrt(2 / q.N_FEATURES) * np.cos(u @ w + b), np.ones((len(rows), 1))])

    def fit(rows):
        z = features(x[rows])
        p = np.diag([ridge] * q.N_FEATURES + [0.0])
        return np.linalg.solve(z.T @ z / len(z) + p, z.T @ y[rows] / len(z))

    every = np.arange(len(x))
    raw = np.zeros(len(x))
    for k in range(1, 5):
        raw[f == k] = features(x[f == k]) @ fit(every[f != k])
    at = np.clip(((raw + 0.5) / 2 * bins).astype(int), 0, bins - 1)
    used = sorted(set(at))
    n = np.array([float((at == u).sum()) for u in used])
    level = np.clip(minmax(n, np.array([y[at == u].mean() for u in used])), 0, 1)
    mid = (np.array(used) + 0.5) / bins * 2 - 0.5
    full = features(np.array([stat[k] for k in range(len(docs))])) @ fit(every)
    return sorted((str(i), round(float(s), 5)) for (i, _), s in zip(docs, np.interp(full, mid, level), strict=True)), features, x


def frames(spark, docs, labels):
    d = spark.createDataFrame([(i, t, "x", 1.0, "x") for i, t in docs], "doc_id long, text string, x string, y double, fold string").repartition(3)
    return d, spark.createDataFrame(labels, "doc_id long, quality int").withColumn("text", F.lit("clash"))


def test_scores(spark):
    docs = [(i, t) for i, t, _ in ROWS] + ODD
    labels = [(i, y) for i, _, y in ROWS] + [(900, 1), (902, None), (3, 0), (None, 1), (5000, 1)]
    got = q.classify(*frames(spark, docs, labels)).collect()
    want, _, _ = plain(docs, labels)
    close = sorted((str(g.doc_id), g.score) for g in got)
    assert [i for i, _ in close] == [i for i, _ in want] and max(abs(a - b) for (_, a), (_, b) in zip(sorted(close), sorted(want), strict=True)) < 2e-4
    assert all(g.predicted == int(g.score >= 0.3) and 0 <= g.score <= 1 for g in got)
    assert {g.doc_id for g in got if g.held_out} == {i for i, _ in docs if i is not None and zlib.crc32(str(i).encode()) % 5 == 0}


def test_features_approximate_the_kernel():
    _, features, x = plain([(i, t) for i, t, _ in ROWS], [(i, y) for i, _, y in ROWS])
    u = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1)
    u = np.clip(u, -6, 6)
    kernel = np.exp(-q.GAMMA * ((u[:, None] - u[None]) ** 2).sum(axis=2))
    z = features(x)[:, :-1]
    assert np.abs(z @ z.T - kernel).mean() < 0.06


def test_without_rows_or_labels(spark):
    docs, labels = frames(spark, ODD, [(900, 1)])
    assert q.classify(docs.filter("false"), labels).collect() == []
    assert {g.score for g in q.classify(docs, labels.filter("false")).collect()} == {0.5}
