"""Every registered query that has SQL, against DuckDB on the small tables."""

import math
import os

import duckdb
import pytest

from lodestar.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    return f"{float(x):.5f}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    cursor = duck.execute(registry.SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    got = sorted([plain(r[c]) for c in sorted(names)] for r in df.collect())
    at = [names.index(c) for c in sorted(names)]
    assert got == sorted([plain(r[k]) for k in at] for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    assert df.count() >= 0 and df.columns
