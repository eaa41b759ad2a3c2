"""Queries over whole tables, held against plain versions."""

import random
import re

import duckdb
from pyspark.sql import functions as F

from quarrylight import catalog
from quarrylight.functions import rules
from quarrylight.functions import text as T
from quarrylight.operators import evidence, rank
from quarrylight.plans.common import QUERY, sources

from .conftest import SF


def test_entity_status_cases(spark):
    names = spark.createDataFrame([(1, "Arden"), (2, "Borel"), (3, "Cossa"), (4, ""), (5, "arden")], "item_id long, name string")
    texts = spark.createDataFrame([("ARDEN, xardeny and Arden: the incumbent",), ("Borel, a candidate",), ("borels, a candidate",), ("Borel is former",), (None,)], "text string")
    got = {r.item_id: (r.status, r.confidence) for r in evidence.entity_status(names, texts, "item_id").collect()}
    assert got == {1: ("incumbent", 0.8), 2: ("candidate", 1.0), 3: ("unknown", 0.3), 4: ("unknown", 0.0), 5: ("incumbent", 0.8)}
    assert evidence.entity_status(names, texts.filter(F.lit(False)), "item_id").count() == 5


def test_entity_names_of_any_kind(spark):
    """Short names, names of several words, accents and signs; the first text with a signal is the evidence."""
    names = spark.createDataFrame([(1, "Li"), (2, "New York"), (3, "João"), (4, "C++"), (5, " Maria  "), (6, "York New"), (7, None), (8, "é"), (9, "new\tyork")], "item_id long, name string")
    texts = spark.createDataFrame([(5, "Li is the incumbent of New York"), (3, "JOÃO, a former (C++)"), (2, "João and new york"), (4, "new\tyork: candidate Maria"), (1, None), (6, "newyork former")], "n long, text string").repartition(3)
    got = {r.item_id: (r.status, r.evidence) for r in evidence.entity_status(names, texts, "item_id", order="n").collect()}
    first = {t.n: (t.text or "").strip() for t in texts.collect()}
    assert got == {1: ("incumbent", first[5]), 2: ("incumbent", first[5]), 3: ("former", first[3]), 4: ("former", first[3]), 5: ("candidate", first[4]), 6: ("unknown", ""), 7: ("unknown", ""), 8: ("unknown", ""), 9: ("candidate", first[4])}


def test_cosine_topk_blocks(spark):
    """Blocks give what one block gives: ties by id, unequal lengths and empty vectors 0."""
    vs = [[1.0, 0.0], [0.0, 1.0], [1.0, 0.0], [], [1.0], [-1.0, 0.0], None] * 5
    v = spark.createDataFrame([(i, x) for i, x in enumerate(vs)], "vec_id long, v array<double>").withColumn("v", F.coalesce("v", F.array().cast("array<double>")))
    q = v.filter("vec_id < 6").selectExpr("vec_id AS query_id", "v AS q")
    got = {(r.query_id, r.place): r.vec_id for r in rank.cosine_topk(q, v, 3, block=4).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) if a and b and len(a) == len(b) else 0.0
    want = {(i, p + 1): j for i in range(6) for p, j in enumerate(sorted(range(len(vs)), key=lambda j: (-dot(vs[i], vs[j]), j))[:3])}
    assert got == want


def plain_chunks(text, size=1200, overlap=160):
    out, i = [], 0
    while i < len(text):
        piece = text[i : i + size]
        at = piece.rfind(" ") if len(piece) == size else len(piece)
        end = i + at + 1 if at > size * 0.55 else i + len(piece)
        out.append(text[i:end].strip())
        if end >= len(text):
            break
        i = max(end - overlap, i + 1)
    return [x for x in out if x]


def test_best_chunk_join_reads_whole_pages(spark):
    words = spark.range(1).select(T.query_terms(F.lit(QUERY))).first()[0]
    want = {}
    for r in sources(spark, SF).collect():
        text = " ".join(". ".join(x for x in (r.title, r.description, r.text) if x).split())
        n, k, best = max(((sum(w in c.lower() for w in words), -k, c) for k, c in enumerate(plain_chunks(text))), default=(0, 0, ""))
        want[r.ord] = (n, best if n else r.description)
    got = {r.ord: (r.score, r.text) for r in catalog.QUERIES["best_chunk_join"](spark, SF).collect()}
    assert got == want


def test_best_chunk_join_finds_the_end_of_a_page(spark, tmp_path):
    html = f"<title>T</title><article><p>{'filler ' * 2000}</p><p>thoning</p></article>"
    spark.createDataFrame([(1, "https://h.org/1", html)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    r = catalog.QUERIES["best_chunk_join"](spark, str(tmp_path)).first()
    assert r.score == 1 and r.text.endswith("thoning")


def test_grounding_confidence_of_odd_rows_is_the_sqls(spark, tmp_path):
    """Null and blank answers, borders beside accented letters, and URLs of every kind."""
    texts = [None, "", "\t ", "I cannot verify", "éi cannot verify", "i cannot verifyé", "PROVIDED ſNIPPETS DO NOT", "not certain, and the supplied snippets do not", "could be outdated_", "plain"]
    urls = [None, "", "no url", "a.gov/x", "http://a.gov.in/x", "https://reuters.com/x", "HTTPS://WWW.A.EDU/x", "https://u:p@b.org/x", "https:///x", " https://lead.org/", "https://c.gov#f"]
    docs = [(i, texts[i % len(texts)]) for i in range(140)]
    pages = [(i, urls[i % len(urls)]) for i in range(90)] + [(None, "https://a.org/")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(catalog.ORACLE["grounding_confidence"]).fetchall()
    got = catalog.QUERIES["grounding_confidence"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and len(want) == 140


def test_route_reads_messages_to_their_end(spark, tmp_path):
    """What decides a route may stand after any number of characters; the SQL says the same."""
    fill = "ertion of thoning " * 40
    ends = ["weather in Testville", "bitcoin price now", "who was ceo in 2023", "explain physics", "show all customers where total over 3", "reviews of device", "latest news", "price of a hotel, open now", ""]
    texts = [fill + e for e in ends] + [e + " " + fill for e in ends] + [a + " " + fill + b for a in ("find", "news", "now", "store", "quote") for b in ("rows, sum", "latest", "stock", "best", "btc")] + ["\n" + fill * 200 + "quote btc", None]
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    spark.read.parquet(f"{SF}/orders.parquet").limit(24).write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    for t in ("conversations", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = {tuple(r) for r in catalog.QUERIES["route_messages"](spark, str(tmp_path)).collect()}
    assert got == set(con.execute(catalog.ORACLE["route_messages"]).fetchall())
    said = {r[0]: r[3] for r in got}
    assert [said[i] for i in range(6)] == ["weather", "crypto", "web_search", "stable_knowledge", "sql_generation", "web_search"]
    assert next(r[4] for r in got if r[0] == 3) == 0.56


def test_ordered_patterns_in_one_look(spark):
    """``A.*B`` by the first A alone gives what the plain pattern gives, and a text of many A takes no look each."""
    found = [p for p in [rules.SQL_VERB, *rules.NO_FREE_SOURCE, *[c[2] for c in rules.CATEGORIES]] if ".*" in p]
    rnd = random.Random(11)
    words = [w for w in dict.fromkeys(w for p in found for w in re.findall("[a-z' ]{3,}", p)) if w.strip()] + ["x", "é", "today's", "shown", "btc_"]
    texts = [rnd.choice([" ", "", "é", "_"]).join(rnd.choice([w, w.upper()]) + rnd.choice([" ", " ", "-", "é"]) for w in rnd.choices(words, k=rnd.randint(1, 12))) for _ in range(3000)]
    t = F.col("t")
    df = spark.createDataFrame([(x,) for x in texts], "t string").repartition(4)
    r = df.select(*[F.sum((T.has(t, p) != rules._in_turn(t, p)).cast("int")).alias(f"w{i}") for i, p in enumerate(found)], *[F.count_if(T.has(t, p)).alias(f"n{i}") for i, p in enumerate(found)]).first()
    assert len(found) == 5 and [r[f"w{i}"] for i in range(5)] == [0] * 5 and all(100 < r[f"n{i}"] < 2900 for i in range(5))
    many = spark.createDataFrame([("show news latex " * 40_000,)], "t string")
    assert many.select(*[rules._in_turn(t, p).alias(f"p{i}") for i, p in enumerate(found)]).first()[0] is False
