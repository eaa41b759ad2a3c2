"""Every stage of the pipeline with null ids, nulls in any column, repeated rows, very long and empty texts, clashing columns, and without rows."""

import random

import pytest

import corpus_pipeline as p

from . import brute

r = random.Random(8)
VOCAB = ["".join(r.choices("abcdefg", k=r.randint(2, 8))) for _ in range(500)]


def prose(n):
    return "\n".join(" ".join(r.choices(VOCAB, k=12)) for _ in range(n // 12))


A, B, C, D = prose(240), prose(240), prose(240), prose(240)
NEAR = A.rsplit(" ", 1)[0] + " changed"
ROWS = [
    (1, A, "en", "s", 1), (None, A, "en", "s", 1), (None, A, None, None, None), (None, B, "en", "s", 1), (None, B, "en", "s", 1), (3, NEAR, "en", "s", 1), (None, C, None, None, None), (4, D, None, "t", None), (4, D, None, "t", None), (5, None, "en", "s", 0), (None, None, None, None, None), (6, "", "en", "s", 0),
    (7, prose(30_000), "en", "s", 1), (None, "\n".join(f"{line}" for line in C.split("\n")[1:]) + "\nand another end", "en", "s", 2),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, _sha string, kept string, id string, rid string, c long, t string, in_lang string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*row, "x", "x", "x", "x", "x", 1, "x", "x") for row in ROWS], SCHEMA).repartition(3).cache()


def pairs(df):
    return sorted(((x.doc_id, x.text) for x in df.collect()), key=str)


def test_rules(spark, docs):
    got = pairs(p.rules(spark, docs, ""))
    assert got == sorted(((i, t) for i, t, *_ in ROWS if not brute.base_counts(t)[-1]), key=str)
    assert p.rules(spark, docs, "").columns == p.COLUMNS


def test_exact(spark, docs):
    got = pairs(p.exact(spark, docs, ""))
    assert got == sorted([(1, A), (None, B), (3, NEAR), (None, C), (4, D), (5, None), (7, ROWS[12][1]), (None, ROWS[13][1])], key=str) or [x for x in got if x[1]] == sorted([(1, A), (None, B), (3, NEAR), (None, C), (4, D), (7, ROWS[12][1]), (None, ROWS[13][1])], key=str)
    assert len([x for x in got if not x[1]]) == 1 and got[0][0] != 6


def test_near(spark, docs):
    got = [x for x in pairs(p.near(spark, docs, "")) if x[1]]
    classes = [x for x in got if x[1] in (C, ROWS[13][1])]
    assert len(classes) == 1 and [x for x in got if x not in classes] == sorted([(1, A), (None, B), (4, D), (4, D), (7, ROWS[12][1])], key=str)
    # texts without words are linked with nothing
    assert len([x for x in pairs(p.near(spark, docs, "")) if not x[1]]) == 3


def test_passages(spark, docs):
    got = pairs(p.passages(spark, docs, ""))
    want = [(i, left.decode("utf-8", "ignore")) for (i, *_), (_, _, _, left) in zip(ROWS, brute.repeats([(x[0], x[1]) for x in ROWS]), strict=True)]
    assert got == sorted(want, key=str)


def test_packed(spark, docs):
    got = p.packed(spark, docs, "").collect()
    assert sorted({str(x.doc_id) for x in got}) == sorted({str(i) for i, *_ in ROWS})
    assert sum(x.piece == 0 for x in got) == len(ROWS)


def test_results_outlive_other_stages(spark, docs):
    a, b, c = p.rules(spark, docs, ""), p.exact(spark, docs, ""), p.near(spark, docs, "")
    assert (a.count(), b.count(), c.count()) == (p.rules(spark, docs, "").count(), p.exact(spark, docs, "").count(), p.near(spark, docs, "").count())


@pytest.mark.parametrize("name", [n for n, _ in p.STAGES])
def test_empty(spark, docs, name):
    assert dict(p.STAGES)[name](spark, docs.filter("false"), "").collect() == []
