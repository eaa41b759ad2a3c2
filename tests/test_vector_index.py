"""The inverted file against exact neighbours."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight import catalog
from quarrylight.operators import rank, vector_index
from quarrylight.plans.texts import _unit

from .conftest import SF


def frames(spark, x, hot=0):
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(len(x) + i, [float(c) for c in x[0]]) for i in range(hot)]
    v = spark.createDataFrame(rows, "vec_id long, v array<double>").withColumn("v", rank.l2_normalize(F.col("v"))).repartition(4).cache()
    return v, v.filter("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "v AS q")


def test_clustered_vectors_need_few_lists(spark):
    r = np.random.default_rng(3)
    x = (r.normal(size=(40, 16))[r.integers(0, 40, 3000)] + 0.1 * r.normal(size=(3000, 16))).round(3)
    v, q = frames(spark, x, hot=1500)
    index = vector_index.fit(v, sample=1500)
    probes = vector_index.probes_for(index, q, v, 10)
    exact = rank.cosine_topk(q, v, 10)
    assert len(index.centroids) == 67 and probes <= 8
    found = vector_index.search(index, q, v, 10, probes, block=100)
    assert found.groupBy("query_id").count().filter("count != 10").count() == 0
    assert vector_index.recall_of(found, exact) >= 0.9
    # all lists give the exact rows, places and ties included; a third of the rows are one vector
    every = vector_index.search(index, q, v, 10, len(index.centroids), block=100)
    assert {tuple(r) for r in every.collect()} == {tuple(r) for r in exact.collect()}


def test_odd_vectors(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, []), (4, [1.0]), (5, [-1.0])], "vec_id long, v array<double>")
    q = v.selectExpr("vec_id AS query_id", "v AS q")
    index = vector_index.fit(v, lists=2)
    got = {(r.query_id, r.place): r.vec_id for r in vector_index.search(index, q, v, 2, 2).collect()}
    assert got == {(0, 1): 0, (0, 2): 2, (1, 1): 1, (1, 2): 0, (2, 1): 0, (2, 2): 2, (3, 1): 3, (4, 1): 4, (4, 2): 5, (5, 1): 5, (5, 2): 4}
    none = v.filter("false")
    index = vector_index.fit(none)
    assert vector_index.search(index, q, none).count() == 0 and vector_index.probes_for(index, q, none) == 1


@pytest.mark.parametrize("name", ["vector_index_topk"])
def test_registered_query_finds_nine_tenths(spark, name):
    u = _unit(spark, SF)
    exact = catalog.QUERIES["cosine_topk_batch"](spark, SF)
    found = catalog.QUERIES[name](spark, SF)
    assert vector_index.recall_of(found, exact) >= 0.9
    assert found.select("query_id").distinct().count() == u.filter("vec_id % 20 = 0").count()


def test_null_vectors(spark, tmp_path):
    """A null vector is no error: it comes after all others, and as a query gets the smallest ids, as the SQL has it."""
    r = np.random.default_rng(5)
    rows = [(i, None if i in (0, 7, 40) else [float(x) for x in r.normal(size=8).round(3)], 0) for i in range(60)]
    rows += [(None, rows[20][1], 0), (2**60 + 1, rows[20][1], 0)]  # without an id: after its equals
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    e.write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {tuple(x) for x in con.execute(catalog.ORACLE["cosine_topk_batch"]).fetchall()}
    assert [x[1] for x in sorted(want, key=lambda x: x[2]) if x[0] == 40] == list(range(10))
    assert {(20, 20, 1), (20, 2**60 + 1, 2), (20, None, 3)} < want
    assert {tuple(x) for x in catalog.QUERIES["cosine_topk_batch"](spark, str(tmp_path)).collect()} == want
    got = catalog.QUERIES["vector_index_topk"](spark, str(tmp_path)).collect()
    assert len(got) == 30 and len({(x.query_id, x.vec_id) for x in got} & {x[:2] for x in want}) >= 27
    assert {(20, 20, 1), (20, 2**60 + 1, 2), (20, None, 3)} < {tuple(x) for x in got}
    # few vectors: null ones take the last places of the exact search
    u = e.filter("vec_id < 9").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    found = rank.cosine_topk(u.filter("vec_id = 1").selectExpr("vec_id AS query_id", "v AS q"), u, 10, block=2).orderBy("place").collect()
    assert [x.vec_id for x in found][-2:] == [0, 7] and len(found) == 9
    none = u.filter("v IS NULL").selectExpr("vec_id", "v")
    asked = none.selectExpr("vec_id AS query_id", "v AS q")
    index = vector_index.fit(none)
    assert sorted(tuple(x) for x in vector_index.search(index, asked, none, 2, vector_index.probes_for(index, asked, none)).collect()) == [(0, 0, 1), (0, 7, 2), (7, 0, 1), (7, 7, 2)]
