"""Every catalogued query against its SQL in DuckDB, where the driver's tables are there."""

import os

import duckdb
import pytest

from gridspark import catalog

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("orders", "events", "part", "customer", "embeddings", "lineitem"):
        c.sql(f"create view {t} as from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.ORACLES])
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, DATA)
    want = con.sql(catalog.ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    order = [want.columns.index(c) for c in cols]
    assert sorted(tuple(str(v) for v in r) for r in got.select(*cols).collect()) == sorted(tuple(str(r[i]) for i in order) for r in want.fetchall())


def test_cross_crs_plan_covers(spark):
    rows = catalog.QUERIES["plan_tiles_cross_crs"](spark, DATA).collect()
    assert sum(r["h"] * r["w"] for r in rows) == 100 * 150 and any(r["has_data"] for r in rows)
