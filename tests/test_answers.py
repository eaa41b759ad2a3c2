"""Literal vectors of answer and evidence functions."""

from pyspark.sql import functions as F

from quarrylight.functions import answers as a
from quarrylight.functions import text as T

from .test_functions import one


def test_sources(spark):
    def ok(kind, title="t", description="", url="https://a.org/x", level=""):
        return one(spark, a.is_answer_source(F.lit(title), F.lit(url), F.lit(description), F.lit(kind), F.lit(""), F.lit(level)))

    assert not ok("archive_lookup", level="structured_claim") and not ok("web", url="https://a.org/search?q=x", description="long enough text here")
    assert ok("official_source") and ok("other", level="structured_claim") and ok("", "a longer title") and not ok("", "short") and not ok("other", "short title")
    assert ok("reference_lookup", "twelve chars") and not ok("reference_lookup", "short", "x" * 39)
    f = lambda m, t, k="": one(spark, a.is_final_source(F.lit(m), F.lit(t), F.lit(""), F.lit("https://a.org"), F.lit("a.org"), F.lit(k), F.lit(False)))
    assert f("rates of tea", "Tea prices") and not f("rates of tea", "Coffee") and f("rates of tea", "Coffee", "trusted_news") and not f("chief minister", "Deputy Chief Minister")
    assert one(spark, a.is_crawlable(F.lit("https://a.org/b"))) and not one(spark, a.is_crawlable(F.lit("https://a.org/b.pdf?x=1")))


def test_escalation(spark):
    e = lambda t: one(spark, a.escalation(F.lit(t)))
    assert e("") == "empty_answer" and e("Please share the source links") == "model_requested_sources_from_user" and e("I don't know") == "uncertain_or_evasive_answer"
    assert e("You can check the official website") == "generic_advice_answer" and e("It is Paris.") is None and e("Please share links to your portfolio, thanks") is None


def test_alignment(spark):
    al = lambda t, r: tuple(one(spark, a.alignment(F.lit(t), F.lit(r))))
    assert al("Alex Rivera is the mayor.", "The mayor is rivera") == ("Alex Rivera", True)
    assert al("Alex Rivera is the mayor.", "nobody") == ("Alex Rivera", False) and al("it rains", "x") == (None, True)


def test_text(spark):
    assert one(spark, a.date_in(F.lit("on 5 March 2024 it"))) == "5 March 2024" and one(spark, a.date_in(F.lit("none"))) == ""
    c = lambda t: one(spark, a.complete(F.lit(t)))
    assert c("It is fine") == "It is fine." and c("Done.") == "Done." and c("```x") == "```x\n```" and c("one and") == "one and" and c("see https://a.org") == "see https://a.org." and c("https://a.org") == "https://a.org"
    assert one(spark, a.is_meta_talk(F.lit("The provided snippets do not say"))) and not one(spark, a.is_meta_talk(F.lit("Paris")))
    assert one(spark, a.strip_meta_talk(F.lit("The search results are thin. However, it is Paris"))) == "it is Paris"
    assert one(spark, a.verification_query(F.lit("Who is the mayor?"), F.lit("Alex Rivera won. Later"))) == "the mayor Alex Rivera"
    assert one(spark, a.wants_ranking(F.lit("find the date"))) and not one(spark, a.wants_ranking(F.lit("summarize and find")))
    assert one(spark, a.metadata_only(F.lit("Attached file: a type: b"))) and not one(spark, a.metadata_only(F.lit("hello")))
    assert one(spark, T.dashes(F.lit("a—b‑c “d’"))) == "a-b-c \"d'"
    assert one(spark, T.confidence_bucket(F.lit(0.9))) == "high" and one(spark, T.confidence_bucket(F.lit(0.9), F.lit("blurred"))) == "medium"


def test_objects(spark):
    box = one(spark, a.overlay_box({"x": F.lit(10), "y": F.lit(20), "right": F.lit(60), "bottom": F.lit(40)}))
    assert tuple(box) == (0.1, 0.2, 0.5, 0.2) and one(spark, a.overlay_box({"x": F.lit(1)})) is None
    o = lambda label, n, c: F.struct(F.lit(label).alias("label"), F.lit(n).alias("count"), F.lit(c).cast("double").alias("confidence"))
    things = F.array(o("text", 1, 0.99), o("cat", 2, 0.7), o("dog", 3, 0.7), o("bird", 1, None))
    assert one(spark, a.objects_line(a.merge_objects(things))) == "text x1, dog x3, cat x2, bird x1" and one(spark, a.top_object(things))["label"] == "dog"
    assert [one(spark, a.attachment_kind(F.lit(n), F.lit(""))) for n in ("a.png", "a.pdf", "a.docx", "a.ppt", "a.zip")] == ["image", "pdf", "doc", "ppt", "file"]
