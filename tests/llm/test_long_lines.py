"""Boilerplate lines of more than 20 words, and republished pages."""

import random

from quarrylight.llm import quality_rules

from . import brute


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(n))


def test_long_lines(spark):
    block = [words(40, 1), words(30, 2), words(25, 3)]
    page = [words(40, 50 + i) for i in range(8)]
    rows = [(i, "h", "\n".join([words(60, 100 + i), words(60, 200 + i), *block])) for i in range(30)]  # a notice of three lines on different texts
    rows += [(40, "h", "\n".join([*block, words(5, 400)]))]  # almost wholly notice
    rows += [(50 + i, "g", "\n".join([*page[: i % 8], words(40, 500 + i), *page[i % 8 + 1 :]])) for i in range(40)]  # one page, edited
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r for r in quality_rules.quality_rules(df, clean=True).collect()}
    for (i, _, t), (lost, clean) in zip(rows, brute.boilerplate(rows), strict=True):
        assert (got[i].n_boilerplate_words, got[i].clean_text) == (lost, clean)
    for i, _, t in rows[:30]:
        assert (got[i].n_boilerplate_words, got[i].kept, got[i].clean_text) == (95, True, "\n".join(t.split("\n")[:2]))
    assert got[40].n_boilerplate_words == 95 and not got[40].kept
    assert all(got[i].n_boilerplate_words == 0 and got[i].kept and got[i].clean_text == t for i, _, t in rows[31:])
