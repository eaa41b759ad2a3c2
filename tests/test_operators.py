"""Operators on small frames: state against plain loops, robots, evidence, conversation, feeds, attachments, streams."""

import io
import random
import zipfile
from collections import OrderedDict

from pyspark.sql import functions as F

from quarrylight.operators import conversation, evidence, rank, state
from quarrylight.sources import attachments, feeds, payloads
from quarrylight.streaming import stateful


def events(spark, rows):
    df = spark.createDataFrame(rows, "k string, ms long, id long, outcome string")
    return df.withColumn("ts", F.timestamp_millis("ms"))


def test_rate_limit(spark):
    e = events(spark, [("a", t, i, "") for i, t in enumerate((0, 10_000, 59_000, 60_000))])
    got = {r.id: r.allowed for r in state.rate_limit(e, "k", F.col("ts"), F.col("id"), 2, 60_000).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True}


def test_breaker(spark):
    e = events(spark, [("a", 0, 0, "severe"), ("a", 30_000, 1, "read"), ("a", 30_001, 2, "read"), ("a", 30_002, 3, "failure"), ("a", 90_000, 4, "ok"), ("a", 90_001, 5, "failure")])
    got = [(r.before, r.after) for r in state.circuit_breaker(e, "k", F.col("ts"), F.col("id"), F.col("outcome")).orderBy("id").collect()]
    assert got == [("CLOSED", "OPEN"), ("OPEN", "OPEN"), ("HALF_OPEN", "HALF_OPEN"), ("HALF_OPEN", "OPEN"), ("HALF_OPEN", "CLOSED"), ("CLOSED", "CLOSED")]


def test_lru(spark):
    rng = random.Random(5)
    rows = [("c", t * 100, t, str(rng.randint(0, 9))) for t in range(300)]
    e = events(spark, rows)
    got = [r.hit for r in state.lru_cache(e, "k", "outcome", F.col("ts"), F.col("id"), 4, 2_000).orderBy("id").collect()]
    held, want = OrderedDict(), []
    for _, t, _, k in rows:
        if k in held and t - held[k] > 2_000:
            del held[k]
        want.append(k in held)
        if k in held:
            held.move_to_end(k)
        else:
            if len(held) >= 4:
                held.popitem(last=False)
            held[k] = t
    assert got == want


def test_streams_equal_batch(spark, tmp_path):
    rng = random.Random(7)
    rows = [(str(rng.randint(0, 5)), t * 1000 + rng.randint(0, 900), t, rng.choice(["ok", "failure", "severe", "read"])) for t in range(400)]
    for part in range(4):  # files in time order
        events(spark, rows[part * 100 : part * 100 + 100]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    e = events(spark, rows)
    src = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run(df, name):
        q = df.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return {tuple(r) for r in spark.table(name).collect()}

    limited = {(r.k, r.id, r.allowed, r.retry_after_s) for r in state.rate_limit(e, "k", F.col("ts"), F.col("id"), 3, 20_000).collect()}
    assert run(stateful.rate_limit(src, "k", 3, 20_000), "limited") == limited
    broken = {(r.k, r.id, r.before, r.after) for r in state.circuit_breaker(e, "k", F.col("ts"), F.col("id"), F.col("outcome"), 2, 5_000).collect()}
    assert run(stateful.circuit_breaker(src, "k", 2, 5_000), "broken") == broken
    cached = {(r.k, r.id, r.hit) for r in state.ttl_cache(e, "k", F.col("ts"), F.col("id"), 9_000).collect()}
    assert run(stateful.ttl_cache(src, "k", 9_000), "cached") == cached


def test_robots(spark):
    robots = spark.createDataFrame([("h", "User-agent: *\nDisallow: /private\nAllow: /private/public")], "host string, robots string")
    pages = spark.createDataFrame([(1, "h", "/private/page"), (2, "h", "/private/public/page"), (3, "g", "/private")], "id long, host string, path string")
    got = {r.id: r.allowed for r in evidence.robots_allow(pages, evidence.robots_rules(robots, "bot/1"), "id").collect()}
    assert got == {1: False, 2: True, 3: True}


def test_grounding(spark):
    a = spark.createDataFrame([(1, "fine"), (2, "I cannot verify this"), (3, ""), (4, "fact")], "answer_id long, text string")
    s = spark.createDataFrame([(1, "https://a.gov/x", True, ""), (1, "https://en.wikipedia.org/y", True, "")], "answer_id long, url string, trusted boolean, kind string")
    got = {r.answer_id: r for r in evidence.grounding(a, s, fact=F.col("answer_id") == 4).collect()}
    assert (got[1].confidence, got[1].tier, got[1].verified, got[1].source_count) == (0.9, "high", True, 2)
    assert (got[2].confidence, got[2].tier, got[2].risk_flags) == (0.1, "unverified", ["model_uncertainty_declared", "no_citations_attached"])
    assert got[3].risk_flags == ["empty_response"] and (got[4].confidence, got[4].verified) == (0.95, True)


def test_compaction_of_long_conversations(spark):
    t = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", "x" * (250 if i == 0 else 3)) for i in range(13)], "conv_id long, turn long, role string, text string")
    block = conversation.compact(t, 10).first()["block"]
    assert block.startswith("[Previous Conversation Digest (3 earlier turns):\n- User: " + "x" * 195 + "…\n- Assistant: xxx\n") and block.count("\n") == 3 + 2 + 9


def test_retrieve_then_rerank(spark):
    scored = spark.createDataFrame([("keys", 0.9), ("other", 0.95), ("rest", 0.1)], "id string, score double")
    logits = spark.createDataFrame([("keys", 4.0), ("other", 1.0)], "id string, logit double")
    got = [r.id for r in rank.retrieve_then_rerank(scored, logits, 2).orderBy("tier", F.desc("key")).collect()]
    assert got == ["keys", "other", "rest"]


def test_feeds(spark):
    rss = "<rss><channel><item><title><![CDATA[A &amp; B]]></title><link>https://x.org/1</link><description>&lt;b&gt;hi&lt;/b&gt; there</description><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate></item><item><title>no link</title></item></channel></rss>"
    atom = '<feed><entry><title>T</title><link href="https://y.org/2"/><summary>s</summary><updated>2024-01-03T00:00:00Z</updated></entry></feed>'
    df = spark.createDataFrame([("a", rss), ("b", atom), ("c", "junk")], "source string, xml string")
    got = {r.source: r for r in feeds.parse_feeds(df).collect()}
    assert (got["a"].title, got["a"].url, got["a"].summary, str(got["a"].published_at)) == ("A & B", "https://x.org/1", "hi there", "2024-01-02 10:00:00")
    assert (got["b"].url, str(got["b"].published_at)) == ("https://y.org/2", "2024-01-03 00:00:00") and len(got) == 2


def _zip(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_attachments(spark, tmp_path):
    long = "The quick brown fox jumps over the lazy dog again and again."
    made = {
        "a.txt": long.encode(),
        "b.pdf": b"%PDF-1.4 (" + long.encode() + b") Tj (two\\)) Tj",
        "c.docx": _zip({"word/document.xml": f"<w:t>{long}</w:t><w:t xml:space='preserve'>A &amp; B</w:t>"}),
        "d.pptx": _zip({"ppt/slides/slide10.xml": f"<a:t>ten {long}</a:t>", "ppt/slides/slide2.xml": "<a:t>two</a:t>"}),
        "e.bin": b"\xff\xfe\x00\x01" * 30,
    }
    for name, content in made.items():
        (tmp_path / name).write_bytes(content)
    got = {r.name: r for r in attachments.extract(attachments.read_files(spark, str(tmp_path))).collect()}
    assert {k: v.method for k, v in got.items()} == {"a.txt": "utf8", "b.pdf": "pdf", "c.docx": "docx", "d.pptx": "pptx", "e.bin": "metadata_only"}
    assert got["b.pdf"].text == long + "\ntwo)" and got["c.docx"].text == long + " A & B" and got["d.pptx"].text.startswith("two\n\nten")


def test_payloads(spark):
    gdelt = '{"articles": [{"title": "T", "url": "https://www.bbc.com/n", "domain": "bbc.com", "seendate": "20240102030405"}]}'
    row = payloads.normalise(spark.createDataFrame([("q", gdelt)], "query string, payload string"), "gdelt").first()
    assert (row.domain, row.date, row.trusted, row.kind) == ("bbc.com", "2024-01-02T03:04:05Z", True, "public_news")
    sparql = '{"results": {"bindings": [{"holder": {"value": "http://www.wikidata.org/entity/Q5"}, "holderLabel": {"value": "A B"}, "start": {"value": "2020-05-06T00:00:00Z"}}]}}'
    c = payloads.claims(spark.createDataFrame([("q", sparql)], "query string, payload string")).first()
    assert (c.url, c.start, c.end) == ("https://www.wikidata.org/wiki/Q5", "2020-05-06", "")
    sse = spark.range(1).select(payloads.sse_events(F.lit('data: {"a":1}\n\n: note\n\ndata: x\ndata: y\n\ndata: [DONE]\n\n')).alias("x")).first()["x"]
    assert sse == ['{"a":1}', "x\ny"]
