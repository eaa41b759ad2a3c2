"""Nearest vectors by an inverted file: centroids, one list of vectors per centroid, and a search that reads only the lists near a query.

Centroids are fitted on a bounded sample (``sample`` vectors, those of least hash); every vector is assigned and searched. A search costs
``queries * probes / lists`` of the exact one. How many probes a corpus needs depends on how its vectors lie, so it is measured: ``probes_for``
takes a bounded sample of queries, finds their exact neighbours in all vectors, and reads off in how many probes each neighbour's list comes.
Clustered vectors need few lists; vectors without structure need about half of all, whatever index is laid over them.

Scale: centroids are the only thing sent to all tasks (``most_lists`` times the dimension). Long lists are cut into blocks, and so are the queries of a list,
so a list that holds a third of all rows spreads over many tasks. Of vectors with equal values only the ``k`` of least id can be among the best ``k``;
the others are left out before anything is dealt, map-side first, and equal queries are asked once.

Defined cases: vectors of another length than the fitted one have a list of their own per length; an empty vector has no neighbours but others of its
list, with score 0; a null vector stands in no list, and a null query gets the ``k`` smallest ids of all vectors, as in ``cosine_topk``; fewer than
``k`` vectors in the probed lists give fewer rows; ties fall to the smaller id; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rank import best_of_blocks, block_entry, cosine_topk, top_k

SAMPLE = 20_000
MOST_LISTS = 4096


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray  # (lists, dimension), unit rows

    def near(self, v: Column, probes: int) -> Column:
        """The ``probes`` lists nearest to a vector, nearest first; a vector of another length has the list ``-1 - length``, a null one none."""
        c, n = self.centroids, min(probes, len(self.centroids))

        @F.pandas_udf("array<int>")
        def lists(vs: pd.Series) -> pd.Series:
            out: list[np.ndarray | None] = [None if v is None else np.array([-1 - len(v)], dtype=np.int32) for v in vs]
            fits = [i for i, v in enumerate(vs) if v is not None and len(v) == c.shape[1] and n]
            if fits:
                x = np.stack([vs.iloc[i] for i in fits])
                for i, row in zip(fits, np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :n], strict=True):
                    out[i] = row.astype(np.int32)
            return pd.Series(out)

        return lists(v)


def fit(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE, rounds: int = 10, most_lists: int = MOST_LISTS) -> Index:
    """Spherical k-means over at most ``sample`` of ``vectors`` (vec_id, v). By default as many lists as the root of the number of vectors, up to ``most_lists``."""
    n = vectors.count()
    got = [np.array(r.v) for r in vectors.filter(F.size("v") > 0).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toLocalIterator()]
    size = max(((len(v), sum(len(w) == len(v) for w in got[:100])) for v in got[:100]), key=lambda x: x[1], default=(0, 0))[0]
    x = np.stack(found) if (found := [v for v in got if len(v) == size]) else np.zeros((0, size))
    x = np.unique(x, axis=0)
    k = min(lists or max(1, round(n**0.5)), most_lists, len(x))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)] if k else np.zeros((0, size))
    for _ in range(rounds if k else 0):
        of = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), c)
    return Index(c)


def probes_for(index: Index, queries: DataFrame, vectors: DataFrame, k: int = 10, recall: float = 0.95, asked: int = 200) -> int:
    """The least number of probes at which at least ``recall`` of the exact ``k`` nearest of ``asked`` sampled queries are found."""
    queries, vectors = queries.filter("q IS NOT NULL"), vectors.filter("v IS NOT NULL")
    some = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(asked)
    exact = cosine_topk(some, vectors, k).select("query_id", "vec_id")
    home = vectors.select("vec_id", F.element_at(index.near(F.col("v"), 1), 1).alias("list"))
    order = some.select("query_id", index.near(F.col("q"), len(index.centroids)).alias("order"))
    ranks = exact.join(home, "vec_id").join(order, "query_id").select(F.array_position("order", F.col("list")).alias("rank")).groupBy("rank").count().collect()  # at most one row per list
    found, total = 0, sum(r["count"] for r in ranks)
    for r in sorted((r for r in ranks if r["rank"]), key=lambda r: r["rank"]):
        found += r["count"]
        if found >= recall * total:
            return int(r["rank"])
    return max(1, len(index.centroids))


def _blocks(rows: DataFrame, entry: Column, block: int, at: str) -> DataFrame:
    """(list, ``at``, n, ``at``_rows): the rows of each list in blocks of about ``block``; ``n`` is the list's number of blocks. ``rows`` has list and id."""
    n = rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n"))
    return rows.join(n, "list").groupBy("list", "n", F.pmod(F.xxhash64("id"), F.col("n")).cast("int").alias(at)).agg(F.collect_list(entry).alias(f"{at}_rows"))


def search(index: Index, queries: DataFrame, vectors: DataFrame, k: int = 10, probes: int = 8, block: int = 512) -> DataFrame:
    """query_id, vec_id, place: for each of ``queries`` (query_id, q) the ``k`` best of ``vectors`` (vec_id, v) in its ``probes`` nearest lists."""
    first = Window.partitionBy("v").orderBy(F.asc_nulls_last("vec_id"))
    held = vectors.filter("v IS NOT NULL").withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k).select(
        F.col("vec_id").alias("id"), "vec_id", "v", F.element_at(index.near(F.col("v"), 1), 1).alias("list")
    )
    one = queries.filter("q IS NOT NULL").groupBy("q").agg(F.min("query_id").alias("query_id"))
    asked = one.select(F.col("query_id").alias("id"), "query_id", "q", F.explode(index.near(F.col("q"), probes)).alias("list"))
    v = _blocks(held, block_entry(), block, "vb")
    q = _blocks(asked, F.struct("query_id", "q"), block, "qb").withColumnRenamed("n", "qn")
    # a block of queries goes once to each block of vectors of its list
    spread = q.join(v.groupBy("list").agg(F.max("n").alias("n")), "list").withColumn("vb", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
    pairs = spread.join(v.drop("n"), ["list", "vb"]).select("qb_rows", "vb_rows")
    best = top_k(pairs.mapInPandas(best_of_blocks(k), "query_id long, vec_id long, x double"), k, [F.desc("x"), F.asc_nulls_last("vec_id")], ["query_id"], "place")
    same = queries.join(one.select(F.col("query_id").alias("asked"), F.col("q")), "q").select("query_id", "asked")
    found = best.select(F.col("query_id").alias("asked"), "vec_id", F.col("place").cast("int").alias("place")).join(same, "asked").select("query_id", "vec_id", "place")
    least = top_k(vectors.select("vec_id"), k, [F.asc_nulls_last("vec_id")], rank="place").select("vec_id", F.col("place").cast("int").alias("place"))
    return found.unionByName(queries.filter("q IS NULL").select("query_id").join(F.broadcast(least)))  # k rows


def recall_of(found: DataFrame, exact: DataFrame) -> float:
    """The share of ``exact`` (query_id, vec_id) that ``found`` holds."""
    hit = exact.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return float(hit.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] or 0.0)
