"""Tables, and the views that stand in for records the driver's tables do not have.

``sources`` reads web pages as retrieved sources: types, trust and dates follow from the page's number, so
both engines see the same rows. ``description`` is a short field to show and to score by, ``text`` the whole
readable text of the page.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls

QUERY = "latest reviews of thention erthe onre and the thoning"
AS_OF = "2024-02-01 00:00:00"
KINDS = ["encyclopedia", "official_source", "trusted_news", "community_discussion", "free_places", "reference_lookup", "public_news"]

Query = Callable[[SparkSession, str], DataFrame]


#: Tables of texts, and the key to deal them by.
TEXTS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}
#: Rows a task where a row's work is far more than its transport; documents are long, and keep their splits.
TASK_ROWS = {"pages": 1000, "conversations": 500, "orders": 40_000}


def spread(df: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """Rows whose work is far more than their transport: dealt by their key where they come in fewer splits than the cluster has cores or, with ``rows``, in splits of more rows than that. So no task grows with the table."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, -(-df.count() // rows)) if rows else cores
    return df.repartition(tasks, key) if df.rdd.getNumPartitions() < tasks else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, TEXTS[name], TASK_ROWS.get(name)) if name in TEXTS else df


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with times of the session's zone."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    n = F.col("page_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (n % len(KINDS) + 1).cast("int"))
    return p.select(
        n.alias("ord"),
        T.html_title(F.col("html")).alias("title"),
        "url",
        urls.host(F.col("url")).alias("domain"),
        F.substring(F.trim(T.html_strip(F.col("html"))), 1, 200).alias("description"),
        F.trim(T.html_strip(F.col("html"))).alias("text"),
        kind.alias("kind"),
        F.when(n % 11 == 0, "structured_claim").otherwise("").alias("level"),
        (n % 3 == 0).alias("trusted"),
        (n % 2 == 0).alias("fetched"),
        F.when(n % 4 == 0, "2024-01-05").otherwise("").alias("date"),
    )


# --- DuckDB text -----------------------------------------------------------------------------------------


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sub(x: str, *pairs: tuple[str, str]) -> str:
    for p, to in pairs:
        x = f"regexp_replace({x}, {lit(p)}, {lit(to)}, 'g')"
    return x


def like(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(pattern)})"


def words(xs: list[str]) -> str:
    return "[" + ", ".join(lit(x) for x in dict.fromkeys(xs)) + "]"


def terms(x: str, shape: str = "[a-z0-9]+", stop: list[str] | None = None) -> str:
    out = f"list_distinct(regexp_extract_all(lower({x}), {lit(shape)}))"
    return f"list_filter({out}, lambda t: NOT list_contains({words(stop)}, t))" if stop else out


def hits(ws: str, *weighted: tuple[str, int]) -> str:
    return " + ".join(f"len(list_filter({ws}, lambda t: contains(lower({x}), t))) * {w}" for x, w in weighted)


def collapse(x: str) -> str:
    return f"trim({sub(x, (chr(92) + 's+', ' '))})"


HOST = r"regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)), '^www\.', '')"
STRIP = sub("html", *[(rf"(?is)<{t}.*?</{t}>", " ") for t in ("script", "style", "nav", "footer")], ("<[^>]*>", " "), (r"\s+", " "))
TITLE = "trim(" + sub(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)", ("<[^>]*>", " "), (r"\s+", " ")) + ")"
SOURCES = f"""sources AS (
SELECT page_id AS ord, {TITLE} AS title, url, {HOST} AS domain, substring(trim({STRIP}), 1, 200) AS description,
  {words(KINDS)}[CAST(page_id % {len(KINDS)} + 1 AS INT)] AS kind,
  CASE WHEN page_id % 11 = 0 THEN 'structured_claim' ELSE '' END AS level, page_id % 3 = 0 AS trusted, page_id % 2 = 0 AS fetched,
  CASE WHEN page_id % 4 = 0 THEN '2024-01-05' ELSE '' END AS date
FROM pages)"""
