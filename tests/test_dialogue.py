"""Literal vectors of the dialogue rules."""

import pytest
from pyspark.sql import functions as F

from quarrylight.functions import dialogue as d

from .test_functions import one


@pytest.mark.parametrize(
    "text, route, reason",
    [
        ("", "clarify", "empty_message"),
        ("hey!", "fast_simple", "casual_conversation"),
        ("tell me a joke", "fast_simple", "joke_request"),
        ("translate this to French", "fast_simple", "transform_request"),
        ("how much medicine dosage should I take", "safety_sensitive", "safety_sensitive_query"),
        ("museums in Rome", "place_grounded", "place_query_requires_evidence"),
        ("latest on rates", "live_required", "source_or_freshness_required"),
        ("explain photosynthesis", "fast_simple", "simple_stable_question"),
        ("write me a long essay on trees", "chat_direct", "default_direct_chat"),
    ],
)
def test_front_route(spark, text, route, reason):
    got = one(spark, d.front_route(F.lit(text)))
    assert (got["route"], got["reason"]) == (route, reason)


@pytest.mark.parametrize("text, code", [("Error network timeout", "network_timeout"), ("AbortError", "aborted"), ("mic denied", "permission_blocked"), ("no results", "retrieval_empty"), ("blank response", "model_empty"), ("odd", "unknown"), ("transient_failure", "network_timeout")])
def test_failure(spark, text, code):
    assert one(spark, d.failure(F.lit(text))) == code


@pytest.mark.parametrize("text, target", [("Coorg, Karnataka around July", "Coorg, Karnataka"), ("Paris, France tomorrow", "Paris, France"), ("Mysore during summer", "Mysore"), ("tea in 2023 for beginners", "tea"), ("today", "today"), ("", "")])
def test_query_target(spark, text, target):
    assert one(spark, d.query_target(F.lit(text))) == target


def test_science(spark):
    assert one(spark, d.speak_science(F.lit("0xFF 255."))) == "hex F F 255."
    assert "9.1093837 times 10 to the -31 kilograms" in one(spark, d.speak_science(F.lit("9.1093837e-31 kg")))
    assert one(spark, d.speak_science(F.lit("H2O -> C-14"))) == "H 2 O yields C 14"
    assert [one(spark, d.token_class(F.lit(x))) for x in ("0x1F", "1e5", "C-14", "3.14159", "H2O", "x")] == ["hex", "sci", "isotope", "decimal", "chem", "value"]


def test_sources(spark):
    got = one(spark, d.split_sources(F.lit("The answer.\n\nSources:\n1. [A b](https://www.a.org/x)\n- Title here — https://b.org/y.\nplain words")))
    assert got["answer"] == "The answer."
    assert [tuple(r) for r in got["sources"]] == [("A b", "https://www.a.org/x", "a.org"), ("Title here", "https://b.org/y", "b.org"), ("plain words", "", "")]


def test_places(spark):
    got = one(spark, d.place_evidence(F.lit("find the Blue Lagoon museum"), F.lit("Blue Lagoon"), F.lit("a spa")))
    assert (got["exactish"], got["level"]) == (True, "strong")
    assert one(spark, d.place_evidence(F.lit("Red Fort Delhi"), F.lit("Fort of Goa"), F.lit("")))["level"] == "none"


def test_small(spark):
    assert one(spark, d.workflow(F.lit("plan my weekend"))) == "plan_weekend" and one(spark, d.workflow(F.lit("x"))) is None
    assert tuple(one(spark, d.budget(F.lit("5 day trip to Goa under inr 20,000")))) == (20000.0, "INR", 5, "Goa")
    assert tuple(one(spark, d.budget(F.lit("a trip")))) == (1200.0, "USD", 3, "your destination")
    assert one(spark, d.forget_key(F.lit("forget that my dog's name is Rex"))) == "dog's name"
    assert [one(spark, d.status_error(F.lit(c))) for c in (200, 401, 429, 503)] == [None, "provider_auth_failed", "rate_limited", "provider_unavailable"]
