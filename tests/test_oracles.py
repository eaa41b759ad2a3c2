"""Every registered query against its oracle on the smallest tables."""

import math

import pytest

from quarrylight import catalog

from .conftest import SF


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, float):
        return f"{round(x, 6):g}"
    return str(x)


def rows(records, names):
    return sorted(tuple(cell(r[n]) for n in sorted(names)) for r in records)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = rows([r.asDict() for r in df.collect()], df.columns)
    rel = duck.sql(catalog.ORACLE[name])
    assert sorted(rel.columns) == sorted(df.columns)
    want = rows([dict(zip(rel.columns, r, strict=True)) for r in rel.limit(10_000_000).fetchall()], rel.columns)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
