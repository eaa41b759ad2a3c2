"""What a query does once a row, it does once: how often texts are gone over, and how much of a table a task holds."""

import re

import pandas as pd
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators import chunk
from quarrylight.plans import texts
from quarrylight.sources import feeds, ingest

from .conftest import SF


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_token_sets_goes_over_a_text_three_times(spark):
    said = plan(texts.token_sets(spark, SF))
    assert said.count("regexp_extract_all(") == 3 and "regexp_replace(" not in said and "split(" not in said


def test_first_terms_of_spaced_texts(spark):
    rows = ["", None, "a the THE x9 x9", "İstanbul é-ab\x0bcd ef_gh ij", "one,two;three\tfour\r\nfive " * 9, "from to " * 40 + "end of it"]
    got = spark.createDataFrame([(t,) for t in rows], "t string").select(T.relevance_terms(F.col("t")).alias("a"), T.spaced_terms(F.col("t"), ["the"], 3, False).alias("b")).collect()
    plain = lambda t, stop, n: [w for w in re.sub(r"[^a-z0-9\s]", " ", (t or "").lower(), flags=re.A).split() if len(w) > 1 and w not in stop][:n]
    assert [(r.a, r.b) for r in got] == [(list(dict.fromkeys(plain(t, T.STOP_RELEVANCE, 16))), plain(t, ["the"], 3)) for t in rows]


def test_chunks_go_out_before_a_batch_ends(spark):
    one = "word " * 40_000
    held = [sum(map(len, cuts)) for cuts in chunk._cuts(iter([pd.Series([one] * 50)]), 1400, 160, None)]
    assert [sum(map(len, x)) for x in chunk._cuts(iter([pd.Series(["a b", "", "c"])]), 1400, 160, None)] == [2] and len(held) > 5 and max(held) * 1400 < 2 * (chunk.HELD + len(one))
    rows = [(i, one if i % 2 else ("" if i % 3 else "a b")) for i in range(40)]
    got = chunk.explode_chunks(spark.createDataFrame(rows, "id long, t string").coalesce(1), "t", most=None).collect()
    assert [(r.id, r.chunk_index, r.chunk) for r in got] == [(i, k, c) for i, t in rows for k, c in enumerate(chunk.cut(t.strip(), 1400, 160, None))]


def test_ingest_makes_its_files_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(len(b))
            yield b

    rows = [("a.txt", b"The quick brown fox jumps over the lazy dog again and again."), ("b.txt", b"short"), ("c.docx", b"PK no archive"), ("d.pdf", b"%PDF-1.4"), ("e.png", b"x"), ("f.bin", b"y")]
    files = spark.createDataFrame(rows, "name string, content binary").mapInPandas(count, "name string, content binary")
    got = ingest.ingest(files).collect()
    assert {r.name: r.ok for r in got} == {n: n == "a.txt" for n, _ in rows} and made.value == len(rows)


def test_feeds_find_each_field_once(spark):
    item = "<item><title>{0}</title><link>{1}</link><description>d {0}</description><pubDate>{2}</pubDate></item>"
    times = ["Mon, 05 Feb 2024 10:00:00 GMT", "5 Feb 2024 10:00:00 +0530", "05 Feb 2024 10:00:00 +0530", "2024-02-05T10:00:00Z", "5 Feb 2024 10:00:00 EST", "2024-02-05", "Feb 5 2024", "31 Feb 2024 10:00:00 GMT", ""]
    rows = [("a", "<rss>" + "".join(item.format(f"t{i}", f"https://x.org/{i}", t) for i, t in enumerate(times)) + item.format("", "u", "") + item.format("t", " ", "") + "</rss>"), ("b", None), ("c", '<feed><entry><title>e</title><link href=""/><id>i</id></entry><entry><title>n</title></entry></feed>')]
    out = feeds.parse_feeds(spark.createDataFrame(rows, "source string, xml string"))
    utc = ["2024-02-05 10:00:00", "2024-02-05 04:30:00", "2024-02-05 04:30:00", "2024-02-05 10:00:00", "2024-02-05 15:00:00", "2024-02-05 00:00:00", None, None, None]
    assert [(r.source, r.ord, r.title, r.url, r.summary, r.p) for r in out.withColumn("p", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss")).orderBy("source", "ord").collect()] == [("a", i, f"t{i}", f"https://x.org/{i}", f"d t{i}", p) for i, p in enumerate(utc)] + [("c", 0, "e", "i", "", None)]
    # an empty field is told from a missing one by a second mention of the same expression
    assert plan(out).count("(?:[a-z]+:)?title") == 2 and plan(out).count("<item") == 1
