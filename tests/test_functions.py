"""Literal vectors of functions and rules."""

import pytest
from pyspark.sql import functions as F

from quarrylight.functions import dates, rules, urls
from quarrylight.functions import text as T
from quarrylight.operators import chunk, rank


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "message, route, category",
    [
        ("guitar strings", "llm", "stable_knowledge"),
        ("guitar chords", "llm", "stable_knowledge"),
        ("explain transformer attention", "llm", "stable_knowledge"),
        ("weather in Testville", "live_required", "weather"),
        ("bitcoin price now", "live_required", "crypto"),
        ("latest government news in Test Republic", "live_required", "government"),
        ("earthquake updates today", "live_required", "disasters"),
        ("score now in fixture league", "live_required", "sports"),
        ("places to visit in Sample Harbor", "live_required", "tourism_food_places"),
        ("restaurants near me open now", "llm", "stable_knowledge"),
        ("", "clarify", "clarify"),
    ],
)
def test_route(spark, message, route, category):
    got = one(spark, rules.route(F.lit(message)))
    assert (got["route"], got["category"]) == (route, category)


def test_date_windows(spark):
    w = one(spark, dates.date_window(F.lit("who won IPL in 2023")))
    assert (w["kind"], w["start"], w["end"]) == ("year", "2023-01-01", "2023-12-31")
    assert one(spark, dates.date_window(F.lit("on 30 February 2024"))) is None
    n = lambda x: F.lit(x)
    assert one(spark, dates.overlaps(n(20220506), n(0), n(20240101), n(20241231)))
    assert not one(spark, dates.overlaps(n(20180101), n(20220505), n(20240101), n(20241231)))


def test_discovery(spark):
    assert one(spark, rules.discovery_subject(F.lit("Founder of penicillin"))) == "penicillin"
    assert not one(spark, rules.is_discovery_source(F.lit("penicillin"), F.lit("Al Capone"), F.lit("was treated with penicillin")))


def test_entities(spark):
    got = one(spark, rules.entity_target(F.lit("Who is the CM of Region Alpha?")))
    assert (got["role"], got["jurisdiction"]) == ("Chief Minister", "Region Alpha")
    assert one(spark, rules.entity_target(F.lit("What is the weather today?"))) is None


def test_urls(spark):
    assert one(spark, urls.canonical_key(F.lit("https://Example.com/A/?q=1#x"))) == "https://example.com/a"
    assert one(spark, urls.normalize(F.lit("https://example.com/a#frag"))) == "https://example.com/a"
    assert not one(spark, urls.is_public(F.lit("http://127.0.0.1:8080/private")))
    assert one(spark, urls.is_trusted_domain(F.lit("state.gov"))) and not one(spark, urls.is_trusted_domain(F.lit("untrusted-blog.xyz")))


def test_citation(spark):
    def ok(kind, fetched=False, description="a description of guitar strings and chords", level=""):
        return one(spark, rules.is_citation(F.lit("guitar strings"), F.lit("Guitar strings"), F.lit("https://a.org/x"), F.lit(description), F.lit(kind), F.lit("a.org"), F.lit(fetched), F.lit(level)))

    assert not ok("reference_lookup") and not ok("archive_lookup") and not ok("official_source")
    assert not one(spark, rules.is_citation(F.lit("guitar strings"), F.lit("Tax office"), F.lit("https://a.gov/x"), F.lit("pay your taxes on time here"), F.lit("official_source"), F.lit("a.gov"), F.lit(True), F.lit("")))
    assert ok("encyclopedia") and ok("official_source", True)


def test_texts(spark):
    assert one(spark, T.readable_text(F.lit("<body><main><p>One &#233;</p><nav>no</nav><p>two<br>three</p></main><p>out</p></body>"))) == "One é\ntwo\nthree"
    assert one(spark, T.html_description(F.lit('<meta content="a b" name="description">'))) == "a b"
    assert one(spark, T.entities(F.lit("&amp;lt; &#x1F600; &#65;"))) == "< 😀 A"
    assert one(spark, T.collapse(F.lit("﻿ a  b\t"))) == "a b"
    assert one(spark, T.half_up(F.lit(-0.5))) == 0.0
    assert one(spark, T.trim_words(F.lit("a b, c"), 2)) == "a b."
    assert one(spark, T.think_parts(F.lit("<think>x</think> y"))).asDict() == {"thought": "x", "response": "y"}
    assert one(spark, T.script_language(F.lit("வணக்கம்"))) == "ta-IN" and one(spark, T.script_language(F.lit("hi"))) is None


def test_chunks(spark):
    text = "word " * 900
    got = one(spark, chunk.chunks(F.lit(text), 1400, 160, 24))
    clean, i, want = text.strip(), 0, []
    while i < len(clean) and len(want) < 24:  # the rule, step by step
        piece = clean[i : i + 1400]
        at = piece.rfind(" ") if len(piece) == 1400 else len(piece)
        end = i + at + 1 if at > 1400 * 0.55 else i + len(piece)
        want.append(clean[i:end].strip())
        if end >= len(clean):
            break
        i = max(end - 160, i + 1)
    assert got == want


def test_vectors(spark):
    v = one(spark, rank.l2_normalize(F.array(F.lit(3.0), F.lit(4.0))))
    assert v == [0.6, 0.8]
    assert one(spark, rank.dot(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))) == 0.0


def test_near_duplicate_sections(spark):
    got = one(spark, rank.dedupe_sections(F.array(F.lit("alpha beta"), F.lit(" alpha  beta"), F.lit("gamma"), F.lit(""))))
    assert got == ["alpha beta", "gamma"]
