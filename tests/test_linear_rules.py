"""Rules over texts give the results of their plain patterns, by patterns that pass over most of a text with one look."""

import random
import re

from pyspark.sql import functions as F

from quarrylight.functions import answers, dialogue, policy, queries, rules
from quarrylight.functions import text as T
from quarrylight.operators import rank


def _patterns(v) -> list[str]:
    if isinstance(v, str):
        return [v] if r"\b" in v else []
    return [p for x in v for p in _patterns(x)] if isinstance(v, (list, tuple)) else []


def test_word_starts_are_borders_of_words(spark):
    found = list(dict.fromkeys(p for m in (rules, policy, dialogue, answers, queries) for n, v in vars(m).items() if n.isupper() for p in _patterns(v)))
    assert len(found) > 100 and sum("(?=[" in T.ascii_words(p).replace(T.BOUNDARY, "") for p in found) > 0.8 * len(found)
    rnd = random.Random(3)
    words = sorted({w for p in found for w in re.findall("[a-z]{2,}", p)}) + ["12", "2024", "May", "é", "_", "x_", "Ann", "?", ".", "-", "3 days"]
    glue = [" ", " ", " ", "  ", "é", "_", "9", "-", "\n", "ſ", "."]
    texts = ["".join(rnd.choice([w, w.upper(), w.title()]) + rnd.choice(glue) for w in rnd.choices(words, k=rnd.randint(1, 40))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    t = F.col("t")
    wrong = df.select(*[F.sum((t.rlike(p.replace(r"\b", T.BOUNDARY)) != T.has(t, p)).cast("int")).alias(f"p{i}") for i, p in enumerate(found)]).first()
    assert [found[i] for i, n in enumerate(wrong) if n] == []


def test_capital_by_the_last_border(spark):
    rnd = random.Random(5)
    bits = ["capital", "capital", " ", " ", " ", "a", "ab", "9", "_", ".", "'", "-", "\n", "é", "x9", "?"]
    texts = list({"".join(rnd.choices(bits, k=rnd.randint(1, 9))) for _ in range(6000)})
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.has(F.col("t"), policy.SOME_CAPITAL)).collect()
    want = re.compile(policy.STABLE_ABOUT[1], re.A)
    assert [t for t, x in got if x != bool(want.search(t))] == [] and 50 < sum(x for _, x in got) < len(got)


def test_work_on_a_row_follows_its_length(spark):
    """One evaluation of a normalised text or a word limit a row, not one a rule."""
    t = F.col("t")
    df = spark.createDataFrame([("a",)], "t string")
    count = lambda c, part: df.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString().count(part)
    assert count(policy.is_stable_fact(t), "regexp_replace") <= 3
    assert count(policy.length_policy(t, F.lit(""), F.lit(""), F.lit(""), F.lit(False)), "regexp_extract") <= 40
    long = spark.createDataFrame([("word " * 20_000 + "capita",)], "t string")
    assert long.select(policy.is_stable_fact(t)).first()[0] is False


def test_sections_are_normalised_once(spark):
    df = spark.createDataFrame([(["a  b", "a b", " c", "", "a b c"],)], "p array<string>").select(rank.dedupe_sections(F.col("p")).alias("kept"))
    assert df.first().kept == ["a  b", "c"]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1


def test_tasks_follow_the_rows(spark, tmp_path):
    from quarrylight.plans.common import spread

    spark.range(10_000).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    out = spread(df, "id", 500)
    assert out.rdd.getNumPartitions() == 20 and out.count() == 10_000
    assert max(out.rdd.glom().map(len).collect()) < 700


def test_pages_are_read_once(spark):
    """The condition on a page's text does not read the text again, nor the pages that are not asked for."""
    from quarrylight import catalog

    from .conftest import SF

    plan = catalog.QUERIES["ranked_readable"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    reads = [line.lstrip(" +-:") for line in plan if "(?is)<main" in line]
    assert reads and not any(line.startswith("Filter") for line in reads)


def test_an_arrival_is_one_entry_of_the_state():
    import pandas as pd

    from quarrylight.streaming.expiring import Fold, _Expiring

    class Handle:
        def __init__(self):
            self.held, self.timers = [], []

        def getValueState(self, *_):
            return self

        getListState = getValueState

        def appendValue(self, row):
            self.held.append(row)

        def registerTimer(self, t):
            self.timers.append(t)

    handle, keyed = Handle(), _Expiring(Fold((-1,), "until bigint", lambda *_: None, lambda s: None, "id bigint"))
    keyed.init(handle)
    list(keyed.handleInputRows(("a",), iter([pd.DataFrame({"t": [3.0, 9.0, None], "id": [1, 2, 3], "x": ["u", None, "w"]})]), None))
    assert handle.held == [([3, 9], [1, 2], ["u", None])] and handle.timers == [10]
