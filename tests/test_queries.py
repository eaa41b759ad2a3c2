"""Literal vectors of query rewriting."""

from pyspark.sql import functions as F

from quarrylight.functions import queries as q

from .test_functions import one


def test_rewrite(spark):
    r = one(spark, q.rewrite(F.lit("search for recent reviews of Subject Device 3")))
    assert (r["subject"], r["intent"], r["fresh"]) == ("Subject Device 3", "reviews", True)
    assert one(spark, q.review_queries(F.lit("recent reviews of Subject Device 3"))) == ["Subject Device 3 reviews", "Subject Device 3 recent reviews", "Subject Device 3 latest reviews"]
    assert one(spark, q.review_queries(F.lit("history of tea"))) == [] and one(spark, q.rewrite(F.lit("")))["intent"] == "general"
    ps = one(spark, q.phases(F.lit("history of tea")))
    assert ps[0] == ["history of tea"] and ps[2][0] == "history of tea official source" and ps[2][1] == "history tea official"
    assert one(spark, q.chat_queries(F.lit("tea"), F.lit("green"))) == ["tea", "latest tea", "tea official update", "tea green"]


def test_offices(spark):
    o = one(spark, q.office(F.lit("who is the prime minister of Region Beta in 2021?")))
    assert tuple(o) == ("prime minister", "P6", "Region Beta")
    assert one(spark, q.office(F.lit("Region Beta mayor")))["jurisdiction"] == "Region Beta" and one(spark, q.office(F.lit("tea prices"))) is None
    text = "Former mayor Ann Old left. Jordan Lee is the current mayor of Region Beta. More follows."
    assert one(spark, q.holder(F.lit(text), "mayor", "Region Beta")) == "Jordan Lee"
    assert one(spark, q.holder(F.lit("The mayor of Region Beta is Jordan Lee."), "mayor", "Region Beta")) == "Jordan Lee."  # a name may end in a stop
    assert one(spark, q.holder(F.lit("Nothing here."), "mayor", "Region Beta")) is None


def test_small(spark):
    assert one(spark, q.claim_range(F.lit("2020"), F.lit(""))) == "2020 onward"
    assert one(spark, q.portal_confidence(F.lit("https://x.gov.in/a"), F.lit(False))) == "medium"
    assert one(spark, q.contextual(F.lit("what about the price"), F.lit("tea exports kenya"))) == "what about the price tea exports kenya"
    assert one(spark, q.contextual(F.lit("Who is Ada Lovelace?"), F.lit("tea exports kenya"))) == "Who is Ada Lovelace?"
    p = one(spark, q.preferences({"response_length": F.lit("short"), "response_style": F.lit("rude")}))
    assert tuple(p) == ("short", None, None)
    assert one(spark, q.market_mode(F.lit(""), F.lit("5 day trip"), F.lit(False), F.lit(True))) == "budget_plan"
    z = one(spark, q.zone_time(F.lit("2024-01-01 00:00:00").cast("timestamp"), "Asia/Kolkata"))
    assert z["local"] == "Monday, January 1, 2024, 5:30:00 AM" and z["year"] == 2024
