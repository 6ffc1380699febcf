"""Every query outside llm against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from seqloom.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


@pytest.fixture(scope="module")
def other():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, other, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(([plain(r[n]) for n in names] for r in df.collect()), key=repr)
    rel = other.sql(catalog.ORACLES[name])
    at = [rel.columns.index(n) for n in names]
    assert sorted(rel.columns) == names
    assert got == sorted(([plain(r[i]) for i in at] for r in rel.fetchall()), key=repr)
