"""Source, feed and official rows by their defaults; ordered lookups, fulfilled calls, and filters of landed answers."""

from pyspark.sql import functions as F

from quarrylight.operators import records

from .test_functions import one


def struct(columns):
    return F.struct(*[c.alias(k) for k, c in columns.items()])


def test_source_row(spark):
    r = one(spark, struct(records.source_row({"title": F.lit(" T "), "url": F.lit("https://www.a.org/x ")}, F.lit(0))))
    assert (r.title, r.url, r.domain, r.kind, r.freshness, r.position, r.trusted, r.signals, r.description) == ("T", "https://www.a.org/x", "a.org", "free_public_source", "unknown", 1, False, ["free_public_source"], "")
    r = one(spark, struct(records.source_row({"kind": F.lit("k"), "trusted": F.lit(None).cast("boolean"), "signals": F.array().cast("array<string>"), "source": F.lit("S")}, F.lit(4))))
    assert (r.kind, r.trusted, r.signals, r.label, r.position) == ("k", False, [], "S", 4)


def test_feed_row(spark):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    feed = records.feed_row({"link": F.lit("https://a.org/x#y"), "title": F.lit(" a\n b "), "date": F.lit("no date"), "source_name": F.lit("N")}, now)
    r = one(spark, struct(feed))
    assert (r.id, r.title, r.url, r.published_at, r.source, str(r.fetched_at)) == ("https://a.org/x", "a b", "https://a.org/x", None, "N", "2024-02-01 00:00:00")
    r = one(spark, struct(records.cached_row(records.feed_row({"url": F.lit("https://a.org/x"), "published_at": F.lit("2024-01-03T00:00:00Z")}, now))))
    assert (r.label, r.freshness) == ("a.org", "cached_recent")
    assert one(spark, struct(records.cached_row(records.feed_row({}, now)))).label == "Latest cache"


def test_official_row(spark):
    row = lambda *a, **k: one(spark, struct(records.official_row(*[F.lit(x) for x in a], "mayor", "Region Beta", **k)))
    r = row("City official", "https://city.gov/", "Page", "Said", "Jordan Lee is the current mayor of Region Beta.", True, signal=F.lit("found"))
    assert (r.title, r.description, r.level, r.holder, r.role, r.confidence) == ("Page", "Said", "official_current_holder", "Jordan Lee", "mayor", "medium")
    assert r.signals == ["official_source", "trusted_domain", "page_fetched", "found", "current_office_claim"]
    r = row("City official", "https://city.org/", None, None, "Jordan Lee is the current mayor of Region Beta.", None, registered=F.lit(True))
    assert (r.title, r.description, r.level, r.freshness, r.holder, r.confidence) == ("City official", "Official source for City updates and primary information.", "unverified_link", "official_homepage_unverified", "", "high")
    assert row("City", "https://c.org", "P", "D", "nothing", True).level == "official_page"


def test_first_found(spark):
    titles = one(spark, records.office_titles(F.lit("Mayor"), F.lit("Beta")))
    assert titles == ["List of mayors of Beta", "List of Mayors of Beta", "Mayor of Beta", "Government of Beta"]
    asked = spark.createDataFrame([(1, titles), (2, ["Nothing", "Government of Beta"]), (3, []), (4, None), (5, ["Empty", "", "Twice"])], "k long, c array<string>")
    articles = spark.createDataFrame([(1, "Government of Beta", "g"), (2, "Mayor of Beta", "m"), (3, "Empty", " "), (4, "Twice", None), (5, "Twice", "second"), (6, "Twice", "third")], "ord long, title string, extract string")
    got = {r.k: (r.candidate, r.extract) for r in records.first_found(asked, articles, "k", "c").collect()}
    assert got == {1: ("Mayor of Beta", "m"), 2: ("Government of Beta", "g"), 5: ("Twice", "second")}


def test_fulfilled(spark):
    calls = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("r", "a", 1)], "query string, provider string, n int")
    outcomes = spark.createDataFrame([("q", "b", "fulfilled", [("x",), ("y",)]), ("q", "a", "rejected", [("lost",)]), ("q", "c", "fulfilled", [("z",)]), ("r", "a", "fulfilled", [])], "query string, provider string, status string, rows array<struct<url: string>>")
    assert sorted((r.query, r.position, r.url) for r in records.fulfilled(calls, outcomes, ["n"]).collect()) == [("q", 1, "x"), ("q", 2, "y"), ("q", 3, "z")]


def test_filters_of_answers(spark):
    events = spark.createDataFrame([("q", 1, "Flood in Goa", "water"), ("q", 2, "Quake", "earth"), ("q", 3, "Storm", "flood"), ("q", 4, "FLOOD", None)], "q string, ord int, title string, kinds string")
    got = records.matching_events(events, F.array(F.lit("flood")), F.col("title"), F.col("kinds"), by="q", most=2).collect()
    assert sorted((r.position, r.ord) for r in got) == [(1, 1), (2, 3)]
    assert records.matching_events(events, F.array().cast("array<string>"), F.col("title"), by="q").count() == 4
    places = spark.createDataFrame([("museums near red fort", 1, "Blue hall", ""), ("museums near red fort", 2, "Red Fort", ""), ("museums near red fort", 3, "A fort", "")], "q string, ord int, title string, description string")
    assert sorted((r.position, r.title) for r in records.matching_places(places, F.col("q"), "q").collect()) == [(1, "Red Fort"), (2, "A fort")]


def test_session_memory(spark):
    turns = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else None, f"tea {i}" if i != 1 else None) for i in range(3)] + [(2, 0, "user", "x" * 301 + "tea")], "conv_id long, turn long, role string, text string")
    held = spark.createDataFrame([(1, 5, "a.txt", "TEA " + "y" * 500), (1, 6, None, "tea"), (1, 7, "c", "tea"), (3, 1, "d", "coffee")], "conv_id long, ord long, name string, text string")
    got = {(r.conv_id, r.place): (r.source, len(r.snippet)) for r in records.session_memory(turns, held, "tea in").collect()}
    assert got == {(1, 1): ("turn_1_user", 5), (1, 2): ("turn_3_user", 5), (1, 3): ("attachment_a.txt", 403), (1, 4): ("attachment_document", 3), (2, 1): ("turn_1_user", 303)}
    assert records.session_memory(turns, held, "a b").count() == 0
