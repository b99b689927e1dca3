"""Contract queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from skyloom.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(data, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = lambda v: float(v) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v if v is None else str(v)
    return sorted(([plain(r[k]) for k in order] for r in data), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.collect(), df.columns)
    if name in ORACLES:
        want = con.sql(ORACLES[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert got == rows(want.fetchall(), want.columns)
