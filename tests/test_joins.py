"""Joins on small frames."""

from pyspark.sql import functions as F

from quarrylight.functions.text import STOP_TOPIC
from quarrylight.operators import joins

from .test_functions import one


def test_best_overlap(spark):
    m = spark.createDataFrame([(1, "the red planet mars mars"), (1, "nothing shared"), (2, "mars")], "k long, text string")
    t = spark.createDataFrame([(1, 0, "venus planet"), (1, 1, "mars rover"), (1, 2, "mars base")], "k long, o long, topic string")
    got = {(r.k, r.text): r.best for r in joins.best_overlap(m, t, "k", "text", "topic", "o", STOP_TOPIC, "text").collect()}
    assert got == {(1, "the red planet mars mars"): "mars rover", (1, "nothing shared"): None, (2, "mars"): None}


def test_select_by_index(spark):
    rows = spark.createDataFrame([(1, 0, "a", False), (1, 1, "b", True), (1, 2, "a", False), (2, 0, "c", True), (2, 1, "d", False)], "q long, i long, url string, strong boolean")
    picks = spark.createDataFrame([(1, 2, 0), (1, 0, 1), (1, 9, 2), (2, 7, 0)], "q long, i long, p long")
    got = {(r.q, r.i) for r in joins.select_by_index(rows, picks, "q", "i", "p", "url", F.col("strong")).collect()}
    assert got == {(1, 2), (2, 0)}


def test_forget(spark):
    memory = spark.createDataFrame([(1, "Dog"), (1, "dog food"), (2, "dog food"), (3, "cat")], "user_id long, key string")
    assert {(r.user_id, r.key) for r in joins.forget(memory, F.lit("dog")).collect()} == {(1, "dog food"), (3, "cat")}


def test_lookup(spark):
    assert one(spark, joins.lookup(F.lit("ETH or btc?"), joins.COINS)) == "bitcoin" and one(spark, joins.lookup(F.lit("gold"), joins.COINS)) is None


def test_rank_items(spark):
    from quarrylight.operators.rank import rank_items

    df = spark.createDataFrame([(1, 0, None, " a  b ", None), (1, 1, "k", None, "v"), (1, 2, None, None, None)], "q long, o long, key string, text string, value string")
    assert [tuple(r) for r in rank_items(df, "q", "o").collect()] == [(1, "item_0", "a b"), (1, "k", "v")]


def test_scan(spark, tmp_path):
    from quarrylight.sources import scan

    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.js").write_text("const secret = 1")
    (tmp_path / "a.js").write_text("let a = 'it\\'s';\nconst secret = \"b\";\n// Ada King Lovelace")
    (tmp_path / "b.md").write_text("secret = sample")
    files = scan.read_tree(spark, str(tmp_path))
    got = {(r.path.rsplit("/", 1)[1], r.found, r.line) for r in scan.scan(files, [("leak", "a secret", r"\bsecret\s*=\s*\S+")], ["sample"]).collect()}
    assert got == {("a.js", 'secret = "b";', 2)}
    assert scan.changed(files, files.filter(F.col("path").endswith("a.js"))).count() == 1
    row = files.filter(F.col("path").endswith("a.js")).select(scan.names(F.col("text")).alias("n"), scan.string_literals(F.col("text")).alias("l")).first()
    assert row.n == ["Ada King Lovelace"] and row.l == ["it\\'s", "b"]
    assert tuple(scan.totals(files, scan.changed(files, files), files.limit(0)).first()) == (2, 2, 0)
