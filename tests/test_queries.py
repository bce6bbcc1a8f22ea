"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from cairn.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    assert registry.QUERIES.keys() == registry.SQL.keys()


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query_equals_its_sql(spark, duck, name):
    frame = registry.QUERIES[name](spark, SF)
    found = duck.execute(registry.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(frame.columns)
    expected = sorted(tuple(map(same, row)) for row in found.fetchall())
    assert sorted(tuple(same(r[c]) for c in names) for r in frame.collect()) == expected
    assert expected
