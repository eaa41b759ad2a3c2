"""Queries over value functions and source shapes. Their inputs are made from orders, documents and pages, so that both engines know what must come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers, dates, dialogue, policy, queries, rules, urls
from ..functions import text as T
from ..operators import joins, merge, rank, state
from ..sources import feeds, payloads, scan
from . import turns
from .common import SOURCES, TASK_ROWS, Query, lit, sources, spread, table
from .texts import _READ as READ_SQL

ROBOTS_SQL = turns.ORACLE["robots_longest_prefix"]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


cat = F.concat


def keys() -> tuple[Column, Column]:
    """The order's own key and its customer's."""
    return F.col("o_orderkey"), F.col("o_custkey")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "orders"), "o_orderkey", TASK_ROWS["orders"])


def of(xs: list) -> Column:
    """An entry of a list by the order's key."""
    return F.element_at(F.array(*[F.lit(x) for x in xs]), (keys()[0] % len(xs) + 1).cast("int"))


def pick(xs: list, by: str = "o_orderkey") -> str:
    return f"[{', '.join(lit(x) if isinstance(x, str) else str(x) for x in xs)}][CAST({by} % {len(xs)} + 1 AS INT)]"


_FILES = ["a.PDF", "b.docx", "c.png", "notes", "e.pptx", "f.txt"]


@query(
    "field_values",
    f"""SELECT o_orderkey, 'v' || o_custkey AS first, CASE WHEN o_custkey >= 10 THEN substring('ab' || o_custkey, 1, 3) || chr(10) || chr(10) || '[Truncated]' ELSE 'ab' || o_custkey END AS clipped,
CAST(least(500, greatest(5, o_custkey)) AS BIGINT) AS clamped, CAST(7 AS BIGINT) AS missing, CAST(least(60, floor(o_custkey / 2.0 + 0.5)) AS BIGINT) AS rounded, {pick(["pdf", "doc", "image", "file", "ppt", "file"])} AS kind,
(o_custkey % 50) / 100.0::DOUBLE AS x, 0.2::DOUBLE AS width, CASE WHEN o_orderkey % 2 = 0 THEN 'short' END AS wish, CASE WHEN o_custkey % 100 >= 82 THEN 'high' WHEN o_custkey % 100 >= 55 THEN 'medium' ELSE 'low' END AS sure FROM orders""",
)
def field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    K, C = keys()
    none = F.lit(None).cast("string")
    box = answers.overlay_box({"x": C % 50, "y": F.lit(10), "right": C % 50 + 20, "bottom": F.lit(40)})
    wish = queries.preferences({"response_length": F.when(K % 2 == 0, "short").otherwise("endless")})
    return orders(spark, sf_dir).select(
        "o_orderkey", T.first_string(F.lit("  "), none, cat(F.lit(" v"), C, F.lit(" "))).alias("first"), T.clip(cat(F.lit("ab"), C, F.lit("\x00 ")), 3).alias("clipped"), T.clamp_int(cat(F.lit(" "), C, F.lit("px")), 5, 500, 1).alias("clamped"),
        T.clamp_int(F.lit("none"), 5, 500, 7).alias("missing"), T.clamp_round(C / 2, 0, 60, 1).alias("rounded"), answers.attachment_kind(of(_FILES), none).alias("kind"), box["x"].alias("x"), box["width"].alias("width"),
        wish["response_length"].alias("wish"), T.confidence_bucket(C % 100 / 100).alias("sure"),
    )


@query(
    "markup_values",
    """SELECT o_orderkey, '<a' || o_custkey || '> "x" ''y'' &amp;' AS xml, 'Tea & ' || o_custkey || ' <b>' AS feed, 'D' || o_custkey AS tag, 'b' || o_custkey AS block, 'Head bold link code ' || o_custkey AS plain, 'a-b "' || o_custkey || '" x' AS dashes,
CASE WHEN o_orderkey % 2 = 0 THEN 'https://ex' || o_custkey || '.org/A' ELSE '' END AS link, CASE WHEN o_orderkey % 2 = 0 THEN 'It is ' || o_custkey || '.' ELSE 'Is it ' || o_custkey || '?' END AS ended, 'take ' || o_custkey AS thought, 'say ' || o_custkey AS said FROM orders""",
)
def markup_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    K, C = keys()
    think = T.think_parts(cat(F.lit("<think> take "), C, F.lit("</think> say "), C))
    return orders(spark, sf_dir).select(
        "o_orderkey", T.xml_entities(cat(F.lit("&lt;a"), C, F.lit("&gt; &quot;x&quot; &apos;y&apos; &amp;amp;"))).alias("xml"), T.feed_text(cat(F.lit("<![CDATA[ Tea &amp; "), C, F.lit(" ]]>  &lt;b&gt;"))).alias("feed"),
        T.first_tag(cat(F.lit('<x><dc:date k="1">D'), C, F.lit("</dc:date></x>")), "date").alias("tag"), T.blocks(cat(F.lit("<item>a</item><item >b"), C, F.lit("</item>")), "item")[1].alias("block"),
        T.strip_markdown(cat(F.lit("# Head **bold** [link](u) ![i](j) `code` "), C)).alias("plain"), T.dashes(cat(F.lit("a—b “"), C, F.lit("” x"))).alias("dashes"),
        urls.candidate(F.when(K % 2 == 0, cat(F.lit("HTTPS://Ex"), C, F.lit(".org/A#f"))).otherwise(cat(F.lit("ftp://ex"), C))).alias("link"),
        answers.complete(F.when(K % 2 == 0, cat(F.lit("It is "), C)).otherwise(cat(F.lit("Is it "), C, F.lit("?")))).alias("ended"), think["thought"].alias("thought"), think["response"].alias("said"),
    )


@query(
    "date_values",
    """WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS d, ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][month(o_orderdate)] AS m, ['January','February','March','April','May','June','July','August','September','October','November','December'][month(o_orderdate)] AS mo FROM orders)
SELECT o_orderkey, strftime(d, '%Y-%m-%d') AS iso, CAST(NULL AS VARCHAR) AS no_day, strftime(d, '%Y-%m-%d') || 'T10:20:30Z' AS stamp, day(d) || ' ' || mo || ' ' || year(d) AS found, 'mayor of P' || o_custkey AS stripped, day(d) || ' ' || m || ' ' || year(d) AS label,
CASE o_orderkey % 3 WHEN 0 THEN strftime(d, '%Y-%m-%d') || ' onward' WHEN 1 THEN 'until ' || strftime(d, '%Y-%m-%d') ELSE strftime(d, '%Y-%m-%d') || ' to 2030-01-01' END AS claim, CAST(strftime(d, '%Y%m%d') AS INT) AS number, year(d) || ', 5:30:00 AM' AS zone FROM o""",
)
def date_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    K, C = keys()
    d = F.col("o_orderdate").cast("date")
    iso = F.date_format(d, "yyyy-MM-dd")
    at = queries.zone_time(d.cast("timestamp"), "Asia/Kolkata")
    claim = F.when(K % 3 == 0, queries.claim_range(iso, F.lit(""))).when(K % 3 == 1, queries.claim_range(F.lit(" "), iso)).otherwise(queries.claim_range(iso, F.lit("2030-01-01")))
    return orders(spark, sf_dir).select(
        "o_orderkey", dates.iso_date(F.year(d), F.month(d), F.dayofmonth(d)).alias("iso"), dates.iso_date(F.year(d), F.lit(2), F.lit(30)).alias("no_day"), dates.gdelt_date(F.date_format(d, "yyyyMMdd'102030'")).alias("stamp"),
        answers.date_in(cat(F.lit("It opened on "), F.date_format(d, "d MMMM yyyy"), F.lit(", they say"))).alias("found"), T.collapse(dates.strip_dates(cat(F.lit("mayor of P"), C, F.lit(" as of 3rd May "), F.year(d)))).alias("stripped"), dates.date_label(iso).alias("label"),
        claim.alias("claim"), dates.compact(iso).alias("number"), F.regexp_extract(at["local"], r"(\d{4}, .*)$", 1).alias("zone"),
    )


_ROLES = ["mayor", "governor", "CEO", "prime minister"]
_PEOPLE = ["Ann Lee", "Bo Chi", "Maria"]


@query(
    "office_questions",
    f"""SELECT o_orderkey, lower({pick(_ROLES)}) AS role, {pick(["P39", "P39", "P169", "P6"])} AS property, 'Place' || o_custkey AS jurisdiction, {pick(_PEOPLE)} AS holder, {pick(["Ann Lee", "", "Bo Chi"])} AS name,
CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS portal FROM orders""",
)
def office_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    K, C = keys()
    o = queries.office(cat(F.lit("who is the "), of(_ROLES), F.lit(" of Place"), C, F.lit("?")))
    page = cat(F.lit("Welcome. The former governor of Goa was Old Man. "), of(_PEOPLE), F.lit(" is the current governor of Goa . News."))
    name = of(["Hon'ble Shri Ann Lee, MP", "the current minister", "Dr. Bo  Chi"])
    portal = queries.portal_confidence(of(["https://www.x.org/", "https://goa.gov.in/a", "https://blog.net"]), K % 3 == 0)
    found = orders(spark, sf_dir).select("o_orderkey", o.alias("o"), queries.holder(page, "governor", "Goa").alias("holder"), queries.holder_name(name).alias("name"), portal.alias("portal"))
    return found.select("o_orderkey", "o.role", "o.property", "o.jurisdiction", "holder", "name", "portal")


@query(
    "search_rewrites",
    """WITH o AS (SELECT o_orderkey, 'latest price of Blue Widget' || o_custkey AS q, 'Blue Widget' || o_custkey AS w FROM orders)
SELECT o_orderkey, q AS query, w AS subject, 'latest' AS intent, true AS fresh, w || ' latest;' || w || ' recent latest;' || w || ' latest latest' AS reviews, q || ';' || w || ' latest;' || w || ' recent latest;' || w || ' latest latest' AS broad,
q || ' official source;' || w || ' official;' || q || ' Wikipedia Wikidata;' || w || ' current source' AS official, q || ';latest ' || q || ';' || q || ' official update;' || q || ' in Goa' AS live, CASE WHEN o_orderkey % 2 = 0 THEN 'show that again ' || w ELSE q END AS asked FROM o""",
)
def search_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    K, C = keys()
    q, w = cat(F.lit("latest price of Blue Widget"), C), cat(F.lit("Blue Widget"), C)
    r = queries.rewrite(cat(F.lit("Please search for "), q, F.lit("?!")))
    p = queries.phases(q)
    asked = F.when(K % 2 == 0, queries.contextual(F.lit("show that again"), w)).otherwise(queries.contextual(q, w))
    found = orders(spark, sf_dir).select("o_orderkey", r.alias("r"), F.array_join(queries.review_queries(q), ";").alias("reviews"), p.alias("p"), F.array_join(queries.chat_queries(q, F.lit("in Goa")), ";").alias("live"), asked.alias("asked"))
    return found.select("o_orderkey", "r.*", "reviews", F.array_join(F.col("p")[1], ";").alias("broad"), F.array_join(F.col("p")[2], ";").alias("official"), "live", "asked")


_SAYS = ["Who is the mayor of X", "find the email in section 3", "summarize the whole pdf", "When is the date"]
_STATUS = [200, 401, 402, 429, 404, 500]
_TOKENS = ["0xFF", "1.5e-03", "C-14", "3.14159", "H2O", "plain"]
_FLOWS = ["plan my weekend", "compare these documents", "fix this error", "hello"]
_MODES = ["market", "news", "", "odd"]


@query(
    "answer_checks",
    f"""SELECT o_orderkey, 'the mayor of X' || o_custkey || ' Ann Lee' AS verify, 'Ann Lee' AS anchor, o_orderkey % 2 = 0 AS accurate, o_orderkey % 2 = 0 AS metadata, o_orderkey % 4 IN (0, 1, 3) AS ranking,
{pick(_STATUS)} AS status, {pick(["", "provider_auth_failed", "provider_quota", "rate_limited", "provider_bad_request", "provider_unavailable"])} AS error, 'favourite tea' || o_custkey AS forget, {pick(["plan_weekend", "compare_docs", "fix_from_screen", ""])} AS flow,
{pick(["hex", "sci", "isotope", "decimal", "chem", "value"])} AS class, CASE WHEN o_orderkey % 2 = 0 THEN 'empty_answer' ELSE '' END AS escalation, CASE o_orderkey % 4 WHEN 0 THEN 'markets' WHEN 1 THEN 'news' WHEN 2 THEN 'budget_plan' ELSE 'exchange' END AS mode,
CASE WHEN o_orderkey % 2 = 0 THEN 'penicillin' END AS discovery, 'It was ' || o_custkey || '.' AS lead FROM orders""",
)
def answer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    K, C = keys()
    status = of(_STATUS)
    aligned = answers.alignment(F.lit("In spring, Ann Lee is mayor. More."), F.when(K % 2 == 0, "It is Lee.").otherwise("It is Bob."))
    meta = answers.metadata_only(F.when(K % 2 == 0, "Attached file: a.pdf Type: pdf").otherwise("Attached file: a.pdf Type: pdf, my resume"))
    mode = queries.market_mode(of(_MODES), F.when(K % 4 == 2, "a trip under 500").otherwise("gold"), K % 4 == 3, F.lit(False))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return orders(spark, sf_dir).select(
        "o_orderkey", answers.verification_query(cat(F.lit("Who is the mayor of X"), C, F.lit("?")), F.lit("Ann Lee is mayor. Yes.")).alias("verify"), aligned["anchor"].alias("anchor"), aligned["accurate"].alias("accurate"), meta.alias("metadata"),
        answers.wants_ranking(of(_SAYS)).alias("ranking"), status.alias("status"), blank(dialogue.status_error(status)).alias("error"), dialogue.forget_key(cat(F.lit("please forget that my favourite tea"), C, F.lit(" is green"))).alias("forget"), blank(dialogue.workflow(of(_FLOWS))).alias("flow"),
        dialogue.token_class(of(_TOKENS)).alias("class"), blank(answers.escalation(F.when(K % 2 == 0, " ").otherwise("It is so."))).alias("escalation"), mode.alias("mode"),
        rules.discovery_subject(F.when(K % 2 == 0, "who discovered the penicillin?").otherwise("what is tea")).alias("discovery"), answers.strip_meta_talk(cat(F.lit("Based on the provided snippets, so it is. However, It was "), C, F.lit("."))).alias("lead"),
    )


_LABELS, _NOTES = ["Goa", "goa river", "Tea", "Goa (film)"], ["state of India", "river", "drink", "1999 film"]


@query(
    "entity_candidates",
    f"""SELECT o_orderkey, CAST(greatest(0, 20 - o_custkey % 30) + {pick([30, 0, 0, 0])} + {pick([12, 12, 0, 12])} + {pick([10, 0, 0, 0])} - {pick([0, 0, 0, 15])} AS INT) AS score FROM orders""",
)
def entity_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, C = keys()
    return orders(spark, sf_dir).select("o_orderkey", rank.candidate_score(F.lit("Goa"), of(_LABELS), of(_NOTES), (C % 30).cast("int")).cast("int").alias("score"))


@query(
    "object_lines",
    """SELECT o_orderkey, CASE WHEN o_custkey % 100 > 50 OR o_custkey % 100 = 50 AND o_orderkey % 5 < 2 THEN 'cat' ELSE 'dog' END AS top, CASE WHEN o_custkey % 100 > 50 OR o_custkey % 100 = 50 AND o_orderkey % 5 < 2 THEN 'screen x1, cat x2, dog x' || (o_orderkey % 5 + 1) ELSE 'screen x1, dog x' || (o_orderkey % 5 + 1) || ', cat x2' END || ', sofa x1' AS line FROM orders""",
)
def object_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    K, C = keys()
    o = lambda label, n, sure: F.struct(F.lit(label).alias("label"), n.cast("int").alias("count"), sure.cast("double").alias("confidence"))
    a = F.array(o("cat", F.lit(2), C % 100 / 100), o("sofa", F.lit(0), F.lit(None)))
    b = F.array(o("dog", K % 5 + 1, F.lit(0.5)), o("screen", F.lit(1), F.lit(0.995)), o(" ", F.lit(1), F.lit(1.0)))
    every = answers.merge_objects(a, b)
    return orders(spark, sf_dir).select("o_orderkey", answers.top_object(every)["label"].alias("top"), answers.objects_line(every).alias("line"))


@query(
    "looked_up",
    f"SELECT o_orderkey, {pick(['bitcoin', 'ethereum', 'solana', ''])} AS coin, {pick([True, False, True, True])} AS holds, {pick([True, False, True, False])} AS relevant FROM orders",
)
def looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    K, _ = keys()
    coin = joins.lookup(cat(F.lit("price of "), of(["BTC", "eth", "Solana", "tea"]), F.lit(" now")), joins.COINS)
    terms = F.when(K % 4 == 0, F.array().cast("array<string>")).when(K % 4 == 1, F.array(F.lit("quake"))).otherwise(F.array(F.lit("quake"), F.lit("flood")))
    place = policy.is_relevant_place(F.lit("museums near red fort"), of(["Red Fort", "Blue hall", "A fort", "The red stone fort"]), F.lit(""))
    return orders(spark, sf_dir).select("o_orderkey", F.coalesce(coin, F.lit("")).alias("coin"), policy.holds_any(F.lit("Floods in Goa"), terms).alias("holds"), place.alias("relevant"))


@query(
    "forgotten_keys",
    "SELECT user_id, key FROM (SELECT DISTINCT o_custkey AS user_id, 'Plan ' || o_orderpriority AS key FROM orders) QUALIFY NOT (key ILIKE '%high%' AND row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN lower(key) = 'plan 2-high' THEN 0 WHEN key ILIKE '%high%' THEN 1 ELSE 2 END, key) = 1)",
)
def forgotten_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, C = keys()
    memory = orders(spark, sf_dir).select(C.alias("user_id"), cat(F.lit("Plan "), F.col("o_orderpriority")).alias("key")).distinct()
    return joins.forget(memory, F.lit(" HIGH"), "key", "user_id").select("user_id", "key")


@query(
    "index_picks",
    """WITH r AS (SELECT o_custkey AS g, o_orderkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS n, 'u' || o_orderpriority AS url, o_totalprice > 150000 AS strong FROM orders),
p AS (SELECT g, id, url, n FROM r WHERE g % 2 = 0 AND n IN (1, 3) QUALIFY row_number() OVER (PARTITION BY g, url ORDER BY -n) = 1),
f AS (SELECT g, id, CAST(row_number() OVER (PARTITION BY g ORDER BY n) AS INT) AS place FROM r WHERE strong AND g NOT IN (SELECT g FROM p) QUALIFY row_number() OVER (PARTITION BY g ORDER BY n) <= 3)
SELECT g, id, CAST(-n AS INT) AS place FROM p UNION ALL SELECT g, id, place FROM f""",
)
def index_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    K, C = keys()
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    r = orders(spark, sf_dir).select(C.alias("g"), K.alias("id"), n.alias("n"), cat(F.lit("u"), F.col("o_orderpriority")).alias("url"), (F.col("o_totalprice") > 150_000).alias("strong"))
    picks = r.filter("g % 2 = 0 AND n IN (1, 3)").select("g", "n", (-F.col("n")).alias("p"))
    return joins.select_by_index(r, picks, "g", "n", "p", "url", F.col("strong")).select("g", "id", "place")


@query(
    "best_threads",
    """WITH m AS (SELECT o_orderkey, o_custkey, o_orderpriority AS p FROM orders), t AS (SELECT o_custkey, min(o_orderkey) AS first, o_orderpriority AS p FROM orders GROUP BY o_custkey, o_orderpriority)
SELECT o_orderkey, 'thread ' || p AS best FROM m""",
)
def best_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.regexp_replace(F.col("o_orderpriority"), "[^A-Z ]", "")
    o = orders(spark, sf_dir)
    talks = o.groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("first")).withColumn("topic", cat(F.lit("thread "), F.col("o_orderpriority")))
    said = o.select("o_orderkey", "o_custkey", cat(F.lit("the "), word, F.lit(" please")).alias("said"))
    return joins.best_overlap(said, talks, "o_custkey", "said", "topic", "first", ["the", "please"], "o_orderkey").select("o_orderkey", "best")


@query(
    "feed_items",
    """WITH o AS (SELECT o_orderkey, o_custkey AS c, o_orderkey % 2 = 0 AS rss, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT 'f' || o_orderkey AS source, CAST(0 AS INT) AS ord, 'Tea & ' || c AS title, 'https://x.org/' || c AS url, CASE WHEN rss THEN 'Long text' ELSE 'Short' END AS summary, strftime(d, '%Y-%m-%d') || ' 10:00:00' AS published FROM o""",
)
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed per order: two items, the second without an address, or an entry."""
    K, C = keys()
    d = F.col("o_orderdate").cast("date")
    rss = cat(F.lit("<rss><item><title>Tea &amp; "), C, F.lit("</title><link>https://x.org/"), C, F.lit("</link><description><![CDATA[<p>Long</p> text]]></description><pubDate>"), F.date_format(d, "EEE, dd MMM yyyy"), F.lit(" 10:00:00 GMT</pubDate></item><item><title>none</title></item></rss>"))
    atom = cat(F.lit("<feed><entry><title>Tea &amp; "), C, F.lit('</title><link rel="self" href="https://x.org/'), C, F.lit('"/><summary>Short</summary><updated>'), F.date_format(d, "yyyy-MM-dd"), F.lit("T10:00:00Z</updated></entry></feed>"))
    made = orders(spark, sf_dir).select(cat(F.lit("f"), K).alias("source"), F.when(K % 2 == 0, rss).otherwise(atom).alias("xml"))
    return feeds.parse_feeds(made).select("source", "ord", "title", "url", "summary", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published"))


#: provider -> payload around the order's customer number, and what its row is to be: title, url, description, kind
_SHAPES = {
    "wikipedia": ('{"query":{"search":[{"title":"Tea %s","snippet":"<b>a</b> drink"}]}}', "Tea %s", "https://en.wikipedia.org/wiki/Tea_%s", "a drink"),
    "gdelt": ('{"articles":[{"title":"Tea %s","url":"https://n.org/%s","domain":"n.org","seendate":"x"}]}', "Tea %s", "https://n.org/%s", "Source: n.org"),
    "wikidata": ('{"search":[{"id":"Q%s","label":"Tea","description":"leaf"}]}', "Tea", "https://www.wikidata.org/wiki/Q%s", "leaf"),
    "serper": ('{"organic":[{"title":"Tea","link":"https://s.org/%s","snippet":"leaf"}]}', "Tea", "https://s.org/%s", "leaf"),
    "serper_news": ('{"news":[{"title":"Tea news","link":"https://s.org/n/%s","snippet":"fresh leaf"}]}', "Tea news", "https://s.org/n/%s", "fresh leaf"),
    "exa": ('{"results":[{"title":"Tea","url":"https://e.org/%s","text":"leaf  of tea"}]}', "Tea", "https://e.org/%s", "leaf of tea"),
    "searxng": ('{"results":[{"title":"Tea","url":"https://w.org/%s","content":"leaf"}]}', "Tea", "https://w.org/%s", "leaf"),
    "weather": ('{"place":{"name":"Goa %s","admin1":"","country":"India"},"current":{"temperature_2m":30.5,"relative_humidity_2m":70},"current_units":{"temperature_2m":"C","relative_humidity_2m":"%%"}}', "Current weather for Goa %s, India", "https://open-meteo.com/", "Temperature: 30.5C | Humidity: 70.0%%"),
    "crypto": ('{"id":"bitcoin","usd":%s,"inr":null,"usd_24h_change":1.25}', "Bitcoin public price", "https://www.coingecko.com/", "USD %s.0 | 24h USD change 1.25%%"),
    "disasters": ('{"events":[{"title":"Flood %s","sources":[{"url":"https://eo.org/%s"}],"geometry":[{"date":"2024-01-05"}],"categories":[{"title":"Floods"}]}]}', "Flood %s", "https://eo.org/%s", "Floods"),
    "sports": ('{"teams":[{"strTeam":"Lions %s","strLeague":"IPL","strDescriptionEN":"","strWebsite":"http://lions.org"}]}', "Lions %s", "https://lions.org/", "IPL"),
    "places": ('{"places":[{"name":"Red Fort %s","display_name":"Red Fort, Delhi","osm_id":7}]}', "Red Fort %s", "https://www.openstreetmap.org/node/7", "Red Fort, Delhi"),
    "summary": ('{"title":"Tea %s","extract":"Tea is a <i>drink</i>.","content_urls":{"desktop":{"page":"https://en.wikipedia.org/wiki/T%s"}}}', "Tea %s", "https://en.wikipedia.org/wiki/T%s", "Tea is a drink ."),
    "instant": ('{"Heading":"Tea %s","AbstractText":"A drink.","AbstractURL":"https://d.org/%s"}', "Tea %s", "https://d.org/%s", "A drink."),
    "extract": ('{"result":{"markdown":"# Tea **leaf** %s","metadata":{"title":"Tea page"},"url":"https://p.org/%s"}}', "Tea page", "https://p.org/%s", "Tea leaf %s"),
}


def _filled(x: str) -> Column:
    return F.format_string(x.replace("%s", "%1$s"), keys()[1].cast("string"))


def _sql(x: str) -> str:
    return " || ".join(lit(p.replace("%%", "%")) for p in x.split("%s")).replace(" || ", " || o_custkey || ") if "%s" in x else lit(x.replace("%%", "%"))


@query(
    "provider_rows",
    " UNION ALL ".join(f"SELECT {lit(p)} AS provider, o_orderkey AS id, {_sql(t)} AS title, {_sql(u)} AS url, {_sql(d)} AS description FROM orders WHERE o_orderkey % {len(_SHAPES)} = {i}" for i, (p, (_, t, u, d)) in enumerate(_SHAPES.items())),
)
def provider_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of every provider's shape, normalised to rows of one shape."""
    K, _ = keys()
    o = orders(spark, sf_dir)
    parts = []
    for i, (provider, (body, *_)) in enumerate(_SHAPES.items()):
        rows = o.filter(K % len(_SHAPES) == i).select(K.cast("string").alias("query"), _filled(body).alias("payload"))
        parts.append(payloads.normalise(rows, provider).select(F.lit(provider).alias("provider"), F.col("query").cast("long").alias("id"), "title", "url", "description"))
    return joins.union_all(parts)


@query(
    "landed_pages",
    """SELECT o_orderkey, 'Tea ' || o_custkey AS title, 'https://x.org/a?b=' || o_custkey AS url, 'A snippet' AS snippet, 'https://archive.org/search?query=tea+' || o_custkey AS lookup, CAST(2 AS INT) AS frames, '{"n":' || o_custkey || '}' || chr(10) || 'more' AS frame FROM orders""",
)
def landed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result page, lookup links and an event stream per order."""
    K, C = keys()
    page = cat(F.lit('<div><a class="result__a" href="/l/?uddg=https%3A%2F%2Fx.org%2Fa%3Fb%3D'), C, F.lit('&rut=1">Tea <b>'), C, F.lit('</b></a><a class="result__snippet" href="x">A  snippet</a></div>'))
    stream = cat(F.lit('event: x\r\ndata: {"n":'), C, F.lit("}\r\ndata: more\r\n\r\ndata: last\n\ndata: [DONE]\n\n"))
    links = payloads.reference_links(orders(spark, sf_dir).select(K.alias("o_orderkey"), cat(F.lit("tea "), C).alias("query")), "query")
    found = orders(spark, sf_dir).select("o_orderkey", "o_custkey", payloads.search_page(page)[0].alias("r"), payloads.sse_events(stream).alias("f"))
    archive = links.filter("title LIKE 'Archive%'").select("query", F.col("url").alias("lookup")).distinct()
    out = found.withColumn("query", cat(F.lit("tea "), C)).join(archive, "query")
    return out.select("o_orderkey", "r.title", "r.url", "r.snippet", "lookup", F.size("f").alias("frames"), F.col("f")[0].alias("frame"))


@query(
    "role_claims",
    "SELECT o_orderkey AS id, 'Ann Lee' AS holder, 'mayor' AS office, strftime(o_orderdate, '%Y-%m-%d') AS start, '' AS \"end\", 'https://www.wikidata.org/wiki/Q' || o_custkey AS url FROM orders",
)
def role_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    K, C = keys()
    body = cat(
        F.lit('{"results":{"bindings":[{"holder":{"value":"http://www.wikidata.org/entity/Q'), C, F.lit('"},"holderLabel":{"value":" Ann Lee "},"officeLabel":{"value":"mayor"},"start":{"value":"'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('T00:00:00Z"}}]}}')
    )
    return payloads.claims(orders(spark, sf_dir).select(K.cast("string").alias("query"), body.alias("payload"))).select(F.col("query").cast("long").alias("id"), "holder", "office", "start", "end", "url")


@query(
    "tree_scan",
    r"""WITH f AS (SELECT o_orderkey, 'line one' || chr(10) || CASE WHEN o_orderkey % 3 = 0 THEN 'key = "abc' || o_custkey || '"' ELSE 'nothing' END || chr(10) || 'Ada King Lovelace met Bob' AS t FROM orders)
SELECT 'src/f' || o_orderkey || '.js' AS path, 'secret' AS category, CAST(2 AS INT) AS line, regexp_extract(t, '"([^"]*)"', 1) AS literal, 'Ada King Lovelace' AS name FROM f WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0""",
)
def tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files made of orders: of those not seen before, where a rule's pattern stands."""
    K, C = keys()
    body = cat(F.lit("line one\n"), F.when(K % 3 == 0, cat(F.lit('key = "abc'), C, F.lit('"'))).otherwise("nothing"), F.lit("\nAda King Lovelace met Bob"))
    files = orders(spark, sf_dir).select(cat(F.lit("src/f"), K, F.lit(".js")).alias("path"), body.alias("text"), K.alias("k")).withColumn("hash", F.sha2("text", 256))
    fresh = scan.changed(files, files.filter("k % 2 = 1"))
    found = scan.scan(fresh, [("secret", "a key in the source", r'key = "[^"]+"')])
    return found.join(fresh, "path").select("path", "category", "line", scan.string_literals(F.col("text"))[0].alias("literal"), scan.names(F.col("text"))[0].alias("name"))


@query("scan_totals", "SELECT count(*) AS files, count(*) FILTER (o_orderkey % 2 = 1) AS cached, count(*) FILTER (o_orderkey % 6 = 0) AS findings FROM orders")
def scan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    K, _ = keys()
    files = orders(spark, sf_dir).select(K.cast("string").alias("path"), F.when(K % 3 == 0, "secret = 1").otherwise("none").alias("text"), K.alias("k")).withColumn("hash", F.sha2("text", 256))
    fresh = scan.changed(files, files.filter("k % 2 = 1"))
    return scan.totals(files, fresh, scan.scan(fresh, [("secret", "named", "secret")]))


@query(
    "source_fields",
    f"""WITH {SOURCES} SELECT ord, substring(title, 1, 180) AS title, url, substring(trim(description), 1, 520) AS description, CAST(1 AS INT) AS n_items, CASE WHEN ord % 2 = 0 THEN title ELSE domain END AS item, domain, CAST(CASE WHEN ord % 3 = 0 THEN 0 ELSE 1 END AS INT) AS n_checked,
CASE WHEN ord % 2 = 0 THEN 'attachment' ELSE 'selection' END AS kind, CAST(CASE WHEN ord % 2 = 0 THEN 5000 ELSE 4000 END AS INT) AS selected, CAST(5000 AS INT) AS answer FROM sources""",
)
def source_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = answers.verification_source(F.col("title"), F.col("url"), F.col("description"), F.lit(""))
    one = lambda title, url: F.array(F.struct(title.alias("title"), url.alias("url"), F.col("description"), F.lit("x").alias("text")))
    item = policy.source_items(one(F.when(F.col("ord") % 2 == 0, F.col("title")).otherwise(" "), F.col("url")))
    checked = policy.verification_sources(one(F.col("title"), F.when(F.col("ord") % 3 == 0, "file:///x").otherwise(F.col("url"))))
    g = policy.selection_grounding(F.when(F.col("ord") % 2 == 0, " Attachment").otherwise(""), F.lit("x" * 5000), F.lit(""))
    return sources(spark, sf_dir).select(
        "ord", v["title"].alias("title"), v["url"].alias("url"), v["description"].alias("description"), F.size(item).alias("n_items"), item[0]["title"].alias("item"), item[0]["domain"].alias("domain"), F.size(checked).alias("n_checked"),
        g["kind"].alias("kind"), F.length(g["selected"]).alias("selected"), F.length(g["answer"]).alias("answer"),
    )


@query(
    "live_answers",
    f"""WITH {SOURCES}, r AS (SELECT ord % 40 AS query_id, ord, title, url, domain, 'Tea ' || title AS shown, row_number() OVER (PARTITION BY ord % 40 ORDER BY trusted DESC, ord) AS n FROM sources WHERE url <> ''),
g AS (SELECT query_id, string_agg('- [' || shown || '](' || url || ')', chr(10) ORDER BY n) FILTER (n <= 3) AS links, max(rtrim(regexp_replace(shown, '[.\\s]+$', ''))) FILTER (n = 1) AS lead FROM r GROUP BY query_id)
SELECT query_id, 'the latest update is: ' || lead || '.' || chr(10) || chr(10) || 'Sources:' || chr(10) || links AS response FROM g""",
)
def live_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sources(spark, sf_dir).select((F.col("ord") % 40).alias("query_id"), "ord", cat(F.lit("Tea "), F.col("title")).alias("title"), F.lit("").alias("description"), "url", "domain", F.lit("encyclopedia").alias("kind"), "trusted")
    asked = rows.select("query_id").distinct().withColumn("message", F.lit("news of tea"))
    return merge.live_updates(asked, rows, "query_id", "ord")


@query(
    "entity_discrepancies",
    """SELECT o_orderkey AS id, 'Ann Lee' AS entity, CASE o_orderkey % 3 WHEN 0 THEN 'candidate' WHEN 1 THEN 'incumbent' ELSE 'unknown' END AS status, CASE WHEN o_orderkey % 3 = 2 THEN 0.3 ELSE 0.8 END::DOUBLE AS confidence, o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AS discrepancy FROM orders""",
)
def entity_discrepancies(spark: SparkSession, sf_dir: str) -> DataFrame:
    K, _ = keys()
    o = orders(spark, sf_dir)
    told = o.select(K.alias("id"), F.lit("Mayor").alias("role"), F.when(K % 2 == 0, "so is the mayor: Ann Lee").otherwise("they met Ann Lee").alias("text"))
    snippet = of(["Ann Lee, a candidate", "Ann Lee took oath", "nobody"])
    rows = o.select(K.alias("id"), F.lit("News").alias("title"), snippet.alias("description"), F.lit(True).alias("trusted")).unionByName(o.select(K.alias("id"), F.lit("x").alias("title"), F.lit("Ann Lee is a former mayor").alias("description"), F.lit(False).alias("trusted")))
    return merge.discrepancies(told, rows, "id")


@query("rotated_keys", "SELECT c_custkey, CAST((c_custkey - 7 + (SELECT count(*) FROM customer)) % (SELECT count(*) FROM customer) AS BIGINT) AS place FROM customer WHERE c_custkey % 3 <> 0")
def rotated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "OPEN").otherwise("CLOSED").alias("state"))
    return state.rotate_keys(keys, 7, "c_custkey").select("c_custkey", F.col("place").cast("long").alias("place"))


@query(
    "ranked_items",
    "SELECT o_custkey, 'k' || o_orderkey AS id, 'Tea ' || o_orderpriority AS text FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 5",
)
def ranked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    K, _ = keys()
    items = orders(spark, sf_dir).select("o_custkey", "o_orderkey", cat(F.lit("k"), K).alias("key"), F.lit(" ").alias("text"), cat(F.lit("Tea  "), F.col("o_orderpriority")).alias("title"))
    return rank.rank_items(items, "o_custkey", "o_orderkey", 5)


_REPLIES = [
    '<think>so</think> {"intent":"greet","response":" Hi %s "}', "Just words %s", '```json\n{"query":" SELECT %s ","query_type":"select","tables_used":["a","b"],"execution_notes":["fast"]}\n```', "", '{"text":"other %s"}',
    '{"query":"SELEC %s","validation_status":{"is_valid":false,"syntax_errors":["typo",""]}}',
]
_READ_AS = [
    ("greet", "Hi %s"), ("casual_chat", "Just words %s"), ("sql_generation", "```sql\nSELECT %s\n```\n**Query Type:** SELECT\n**Tables Used:** a, b\n**Estimated Complexity:** Normal\n**Syntax Validation:** Passed\n\n**Execution Notes:**\n- fast"),
    ("service_unavailable", policy.SORRY), ("casual_chat", "other %s"), ("sql_generation", "```sql\nSELEC %s\n```\n**Query Type:** SELECT\n**Tables Used:** N/A\n**Estimated Complexity:** Normal\n**Syntax Errors:** typo"),
]


@query(
    "model_replies",
    f"SELECT o_orderkey, {pick([a for a, _ in _READ_AS])} AS intent, replace({pick([b for _, b in _READ_AS])}, '%s', o_custkey::VARCHAR) AS response, CASE WHEN o_orderkey % 6 = 0 THEN 'so' ELSE '' END AS thought, 'a ' || o_custkey || ' cat' AS seen, o_orderkey % 4 IN (0, 1) AS card, CASE WHEN o_orderkey % 2 = 0 THEN 'page ' || o_custkey ELSE 'page ' || o_custkey || chr(10) || chr(10) || 'picture' END AS pdf, CAST(1 AS INT) AS marks FROM orders",
)
def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    K, C = keys()
    reply = policy.model_reply(F.replace(of(_REPLIES), F.lit("%s"), C.cast("string")))
    seen = policy.vision_text(cat(F.lit('```json\n{"summary": "a '), C, F.lit(' cat", "confidence": 0.9, "objects": [1, 2]}\n```')))
    card = policy.shows_failure_card(of(["network timeout", "no usable results", "odd", "camera denied"]), of(["weather in Goa", "price of tea", "weather", "hello there"]))
    pdf = policy.merged_pdf_text(cat(F.lit("page "), C), cat(F.lit(" page "), C, F.lit(" ")), F.when(K % 2 == 0, " ").otherwise("picture"))
    mark = lambda label, w: F.struct(F.lit(label).alias("label"), F.lit(10.0).alias("x"), F.lit(10.0).alias("y"), F.lit(w).alias("width"), F.lit(5.0).alias("height"))
    marks = policy.overlay_items(F.array(mark(" total ", 20.0), mark("", 20.0), mark("none", 0.0)))
    found = orders(spark, sf_dir).select("o_orderkey", reply.alias("r"), seen.alias("seen"), card.alias("card"), pdf.alias("pdf"), F.size(marks).alias("marks"))
    return found.select("o_orderkey", "r.*", "seen", "card", "pdf", "marks")


@query(
    "current_claims",
    """WITH c AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS s, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE 1 END AS e FROM orders)
SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY e IS NOT NULL, s DESC, o_orderkey) AS INT) AS current, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY s, o_orderkey) AS INT) AS listed FROM c""",
)
def current_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    c = orders(spark, sf_dir).withColumns({"start": F.col("o_orderdate").cast("date"), "end": F.when(F.col("o_orderstatus") != "O", 1)})
    at = lambda now: F.row_number().over(Window.partitionBy("o_custkey").orderBy(*merge.claim_order(now), "o_orderkey"))
    return c.select("o_custkey", "o_orderkey", at(True).alias("current"), at(False).alias("listed"))


@query(
    "refreshed_search",
    "WITH h AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice > 250000), a AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice > 100000) SELECT * FROM h UNION ALL SELECT * FROM a WHERE o_custkey NOT IN (SELECT o_custkey FROM h)",
)
def refreshed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir)
    found, again = (o.filter(F.col("o_totalprice") > n).select("o_custkey", "o_orderkey") for n in (250_000, 100_000))
    return merge.or_refreshed(found, again, "o_custkey")


@query(
    "readable_results",
    f"""WITH allowed AS ({ROBOTS_SQL}), r AS (SELECT page_id, {READ_SQL} AS t FROM pages) SELECT page_id, CAST(length(substring(t, 1, 12000)) AS INT) AS n_chars FROM r JOIN allowed USING (page_id) WHERE allowed AND length(t) >= 120""",
)
def readable_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results whose site lets robots in and whose page holds a readable text of 120 characters or more."""
    pages = table(spark, sf_dir, "pages").select("page_id", T.readable_text(F.col("html")).alias("t"))
    allowed = turns.robots_longest_prefix(spark, sf_dir).filter("allowed").select("page_id")
    return pages.join(allowed, "page_id").filter(F.length("t") >= 120).select("page_id", F.length("t").alias("n_chars"))
