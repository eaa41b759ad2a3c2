"""The queries that SQL can express against their oracles on the smallest tables."""

import pytest

from quarrylight.llm import queries

from ..conftest import SF
from ..test_oracles import rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    rel = duck.sql(queries.ORACLE[name])
    assert sorted(rel.columns) == sorted(df.columns)
    got = rows([r.asDict() for r in df.collect()], df.columns)
    assert got == rows([dict(zip(rel.columns, r, strict=True)) for r in rel.limit(10_000_000).fetchall()], rel.columns)
