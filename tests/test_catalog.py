"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from corvane import catalog

TABLES = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for n in NAMES:
        c.execute(f"create view {n} as select * from read_parquet('{TABLES}/{n}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, bool) or v is None:
        return str(v)
    return f"{float(v):.9g}" if isinstance(v, int) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, TABLES)
    cur = con.execute(catalog.SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(columns)
    want = sorted(tuple(plain(r[columns.index(c)]) for c in got.columns) for r in cur.fetchall())
    assert sorted(tuple(map(plain, r)) for r in got.collect()) == want


def test_driver_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["node_key", "tier", "claim", "freshness"]
    assert set(catalog.QUERIES) <= set(e.queries()) and set(catalog.SQL) <= set(e.oracle_sql()) <= set(e.queries())
