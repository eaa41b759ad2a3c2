"""Results put together: rerankings, phases of a search, and filters that fall back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import answers, policy, rules, urls
from ..functions.text import s, trim
from . import evidence

#: Words and names that are no person by themselves.
NO_ENTITY = ["Chief", "Minister", "Prime", "President", "Governor", "Mayor", "Wikipedia", "Source", "News", "Article", "India", "Tamil", "Nadu"]


def rerank_merge(rows: DataFrame, ranked: DataFrame, by: str, order: str) -> DataFrame:
    """``rows`` in their new order, by group: first those of ``ranked`` (by, order, place), then the rest in theirs; one row per address or title."""
    key = F.coalesce(F.nullif(trim(F.col("url")), F.lit("")), trim(F.col("title")))
    joined = rows.join(ranked.select(by, order, "place"), [by, order], "left").withColumn("_key", key).filter("_key <> ''")
    rank = F.struct(F.col("place").isNull().alias("rest"), F.coalesce("place", order).alias("at"), F.col(order).alias("o"))
    first = joined.groupBy(by, "_key").agg(F.min(F.struct(rank.alias("rank"), F.col(order).alias(order))).alias("m")).select(by, F.col(f"m.{order}").alias(order), F.col("m.rank").alias("rank"))
    return first.select(by, order, F.row_number().over(Window.partitionBy(by).orderBy("rank")).alias("position"))


def picked(rows: DataFrame, picks: DataFrame, by: str, index: str, most: int = 8) -> DataFrame:
    """Rows that a judge picked by index, in the judge's order: no index twice, none it called irrelevant, ``most`` of a group; its descriptions win."""
    ok = picks.filter(F.lower(s(F.col("relevance"))) != "irrelevant").groupBy(by, index).agg(F.min("place").alias("place"), F.min_by("said", "place").alias("said"))
    out = ok.join(rows, [by, index]).withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy("place"))).filter(F.col("position") <= most)
    said = F.substring(F.coalesce(F.nullif(trim(F.col("said")), F.lit("")), s(F.col("description"))), 1, 320)
    return out.select(by, index, "position", said.alias("description"))


def lateral(queries: DataFrame, providers: list[tuple[str, int]]) -> DataFrame:
    """Every query with every provider (a fixed list with limits): query columns, provider, most."""
    dim = F.array(*[F.struct(F.lit(p).alias("provider"), F.lit(n).alias("most")) for p, n in providers])
    return queries.withColumn("_p", F.explode(dim)).select(*queries.columns, "_p.provider", "_p.most")


def filter_or(rows: DataFrame, by: str, wanted: Column, fallback: Column) -> DataFrame:
    """A group's wanted rows; where it has none, those of the fallback."""
    any_wanted = rows.groupBy(by).agg(F.max(F.coalesce(wanted, F.lit(False))).alias("_any"))
    return rows.join(any_wanted, by).filter(F.when(F.col("_any"), wanted).otherwise(fallback)).drop("_any")


def phased(rows: DataFrame, by: str, order: str, n_phases: int) -> DataFrame:
    """by, phase, pass, confidence, n_evidence: the search of each group stops after the first phase whose evidence, with that of the phases before, passes.

    ``rows`` has phase (from 1) and the columns of the evidence gate. A row counts from its phase on, once per address.
    """
    first = rows.withColumn("_key", urls.canonical_key(F.col("url"))).filter("_key <> ''")
    first = first.join(first.groupBy(by, "_key").agg(F.min(F.struct("phase", order)).alias("_m")).select(by, "_key", F.col("_m.phase").alias("_p"), F.col(f"_m.{order}").alias("_o")), [by, "_key"])
    first = first.filter((F.col("phase") == F.col("_p")) & (F.col(order) == F.col("_o")))
    at = first.withColumn("_at", F.explode(F.sequence("phase", F.lit(n_phases)))).withColumn("_g", F.struct(F.col(by), F.col("_at").alias("at")))
    gates = evidence.gate(at, "_g").select(F.col(f"_g.{by}").alias(by), F.col("_g.at").alias("phase"), "pass", "confidence", "n_evidence")
    best = F.min(F.struct((~F.col("pass")).alias("no"), F.when(F.col("pass"), F.col("phase")).otherwise(-F.col("phase")).alias("p"), "phase", "confidence", "n_evidence"))
    return gates.groupBy(by).agg(best.alias("b")).select(by, "b.phase", (~F.col("b.no")).alias("pass"), "b.confidence", "b.n_evidence")


def live_updates(asked: DataFrame, sources: DataFrame, by: str, order: str, most: int = 3) -> DataFrame:
    """by, response: one sentence of the leading source and links of the top ``most`` final sources of each question.

    ``asked`` has by and message; ``sources`` by, order, title, description, url, domain, kind, trusted.
    """
    c = {k: F.col(k) for k in ("title", "description", "url", "domain", "kind", "trusted")}
    rows = sources.join(asked.select(by, "message"), by)
    rows = rows.withColumn("_s", answers.lead_score(F.col("message"), c["title"], c["description"], c["domain"], c["kind"], c["trusted"]))
    rows = rows.withColumn("_final", answers.is_final_source(F.col("message"), c["title"], c["description"], c["url"], c["domain"], c["kind"], c["trusted"]))
    linked = rows.filter(trim(F.col("url")) != "")
    chosen = filter_or(linked, by, F.col("_final"), F.lit(True))
    top = chosen.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("_s"), order))).filter(F.col("_r") <= most)
    item = F.struct("_r", "title", "description", "url", "domain")
    got = top.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("_top"))
    # the dates of the first six sources stand in where the lead has none
    early = rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter(F.col("_n") <= 6)
    early = early.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_n", "title", "description"))).alias("_early"))
    out = asked.join(got, by, "left").join(early, by, "left")
    lead = F.get("_top", F.lit(0))
    line = policy.update_line(F.col("message"), s(lead["title"]), s(lead["description"]), F.coalesce("_early", F.array().cast("array<struct<_n:int,title:string,description:string>>")))
    links = F.array_join(F.transform("_top", lambda x: F.concat(F.lit("- ["), F.coalesce(F.nullif(trim(x["title"]), F.lit("")), F.nullif(s(x["domain"]), F.lit("")), x["url"]), F.lit("]("), trim(x["url"]), F.lit(")"))), "\n")
    return out.select(by, F.when(F.col("_top").isNotNull(), F.concat(line, F.lit("\n\nSources:\n"), links)).otherwise(line).alias("response"))


def named(x: Column, most: int = 6) -> Column:
    """Up to ``most`` distinct proper names of a text, in order."""
    found = F.transform(F.regexp_extract_all(s(x), F.lit(r"(\b[A-Z][a-zA-Z.\s]{2,30}\b)"), 1), lambda n: F.trim(n))
    return F.slice(F.array_distinct(F.filter(found, lambda n: (F.length(n) >= 3) & ~n.isin(*NO_ENTITY))), 1, most)


def discrepancies(answered: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """key, entity, status, confidence, discrepancy: the names of each answer against its snippets, trusted ones where there are any.

    ``answered`` has key, role and text; ``sources`` key, title, description and trusted. A name that the snippets call a
    candidate while the answer says that someone holds the office is a discrepancy.
    """
    used = filter_or(sources, key, F.col("trusted"), F.lit(True))
    names = answered.select(key, F.explode(named(F.col("text"))).alias("entity"))
    said = F.lower(F.concat_ws(" ", s(F.col("title")), s(F.col("description"))))
    pairs = names.join(used.select(key, said.alias("_t")), key).filter(F.contains("_t", F.lower("entity")))
    signal = lambda p, n: (2 * F.count_if(F.col("_t").rlike(p))).alias(n)
    counts = pairs.groupBy(key, "entity").agg(signal(evidence.INCUMBENT, "i"), signal(evidence.FORMERLY, "f"), signal(evidence.CANDIDATE, "c"))
    i, f, c = (F.coalesce(F.col(x), F.lit(0)) for x in "ifc")
    status = F.when((i > f) & (i > c), "incumbent").when(c > i, "candidate").when(f > i, "former").otherwise("unknown")
    n = F.when(status == "incumbent", i).when(status == "candidate", c).when(status == "former", f)
    rows = names.join(counts, [key, "entity"], "left").withColumns({"status": status, "confidence": F.round(F.when(n.isNull(), 0.3).otherwise(F.least(F.lit(1.0), 0.6 + n * 0.1)), 2)})
    claims = answered.select(key, F.lower("text").contains(F.concat(F.lit("is the "), F.lower("role"))).alias("_a"), F.lower("text").contains(F.concat(F.lit("is the current "), F.lower("role"))).alias("_b"))
    return rows.join(claims, key).select(key, "entity", "status", "confidence", ((F.col("status") == "candidate") & (F.col("_a") | F.col("_b"))).alias("discrepancy"))


def retained(turns: DataFrame, most: int, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last ``3 * most`` turns of each conversation."""
    return turns.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter(F.col("_r") <= 3 * most).drop("_r")


def retract(turns: DataFrame, discards: DataFrame, key: str = "conv_id") -> DataFrame:
    """Turns without those whose id or turn id was discarded in their conversation."""
    gone = discards.select(key, F.col("discarded").cast("string").alias("_d")).filter("_d IS NOT NULL AND trim(_d) <> ''").distinct()
    left = turns.join(gone, (turns[key] == gone[key]) & (turns["id"].cast("string") == gone["_d"]), "left_anti")
    return left.join(gone, (left[key] == gone[key]) & (left["turn_id"].cast("string") == gone["_d"]), "left_anti")


def recorded(turns: DataFrame, status: str = "status") -> DataFrame:
    """Turns that a conversation keeps: none that were aborted, failed, or only steered it."""
    return turns.filter(~F.lower(s(F.col(status))).isin("aborted", "error", "control"))


def or_refreshed(found: DataFrame, again: DataFrame, by: str) -> DataFrame:
    """What a search found; for groups without any, what it finds after a refresh."""
    return found.unionByName(again.join(found.select(by).distinct(), by, "left_anti"))


def claim_order(current: bool, start: str = "start", end: str = "end") -> list[Column]:
    """Claims of an office in order: for the current holder open ends first, then the latest start; in a window the earliest start."""
    return [F.col(end).isNotNull(), F.desc(start)] if current else [F.asc(start)]
