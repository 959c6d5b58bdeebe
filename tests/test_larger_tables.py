"""Queries at sf0.1 against their SQL as written for that table's grid: the registered texts are for the 100 rows of sf0.01."""

import inspect
import os
import re

import duckdb
import pytest

from gridspark import catalog

DATA = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
#: Rows at most where a sum within its error of a tie may round the other way, as the order of its terms is free.
TIES = {"tile_average_utm33_to_4326": 3, "tile_lanczos_utm33_to_4326": 3}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in catalog.RASTERS:
        c.sql(f"create view {t} as from '{DATA}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def texts(con):
    rows = {t: con.sql(f"select max({key}) // {width} + 1 from {t}").fetchall()[0][0] for t, (key, _, width, *_) in catalog.RASTERS.items()}
    code, n = re.subn(r"^ROWS = .*$", f"ROWS = {rows}", inspect.getsource(catalog), flags=re.M)
    assert n == 1 and min(rows.values()) > 100
    scope = {"__name__": "catalog_of_larger_tables"}
    exec(compile(code, "catalog_of_larger_tables", "exec"), scope)
    return scope["ORACLES"]


@pytest.mark.parametrize(
    "name",
    [
        "warp_bilinear_3857_to_4326",
        "dataset_two_types",
        "mosaic_two_zones",
        "tile_average_down4_chunked",
        "tile_average_utm33_to_4326",
        "tile_bilinear_utm33_to_4326",
        "tile_cubic_utm33_to_4326",
        "tile_lanczos_utm33_to_4326",
        "tile_nearest_utm33_to_4326",
        "warp_average_down2",
        "warp_average_down4",
        "warp_average_frac",
        "warp_average_utm33_to_4326",
        "warp_bilinear_same_crs_shift",
    ],
)
def test_query(spark, con, texts, name):
    places = lambda columns: [c for c in ("variable", "row", "col") if c in columns]
    got, want = catalog.QUERIES[name](spark, DATA), con.sql(texts[name])
    keys = places(got.columns)
    assert keys == places(want.columns)
    rows, sql = ({r[:-1]: r[-1] for r in of} for of in (map(tuple, got.select(*keys, "v").collect()), want.select(", ".join([*(f'"{k}"' for k in keys), "v"])).fetchall()))
    assert rows.keys() == sql.keys() and max(r[-2] for r in rows) > 100
    off = [abs(rows[k] - sql[k]) for k in rows if rows[k] != sql[k]]
    assert len(off) <= TIES.get(name, 0) and max(off, default=0) < 1.01e-4
