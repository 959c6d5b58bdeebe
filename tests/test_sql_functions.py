"""Functions for SQL against the driver-side values; plans made by tasks against plans made by the driver."""

import numpy as np
import pytest

from gridspark.functions.sql import register
from gridspark.operators.tiles import reproject_tiles
from gridspark.plans.grid import Affine, Grid, projected_grid, transform
from gridspark.plans.planner import plan_frame, plan_reproject, plan_table
from gridspark.raster import RasterFrame

SRC = Grid("EPSG:32633", (40, 50), Affine(100, 0, 500000, 0, -100, 6600000))


def test_functions(spark):
    register(spark)
    t = Affine(80, 20, 500000, 15, -90, 6600000)
    six = f"named_struct({', '.join(f"'{k}', {float(v)}D" for k, v in t._asdict().items())})"
    p = spark.sql(f"select affine_forward(3.5D, 2.5D, {six}) as p, affine_inverse(500330D, 6599827.5D, {six}) as q").first()
    assert tuple(p["p"]) == pytest.approx(t.forward(3.5, 2.5)) and tuple(p["q"]) == pytest.approx((3.5, 2.5))
    zero = "named_struct('a', 0D, 'b', 0D, 'c', 0D, 'd', 0D, 'e', 0D, 'f', 0D)"
    assert tuple(spark.sql(f"select affine_inverse(1D, 1D, {zero}) as q").first()["q"]) == (None, None)
    assert tuple(spark.sql("select is_nodata(null, 1D), is_nodata(double('NaN'), null), is_nodata(-9D, -9D), is_nodata(1D, null)").first()) == (True, True, True, False)
    rows = spark.sql(
        "select i, transform_point(x, y, s, d) as p from values (0, 15D, 59D, 'EPSG:4326', 'EPSG:32633'), (1, 15D, 59D, 'EPSG:4326', 'EPSG:3857'), "
        "(2, null, 59D, 'EPSG:4326', 'EPSG:3857'), (3, 15D, 59D, null, 'EPSG:3857') as t(i, x, y, s, d) order by i"
    ).collect()
    for r, crs in zip(rows, ("EPSG:32633", "EPSG:3857"), strict=False):
        assert tuple(r["p"]) == pytest.approx([float(v[0]) for v in transform("EPSG:4326", crs, [15.0], [59.0])])
    assert all(v is None or np.isnan(v) for r in rows[2:] for v in r["p"])


@pytest.mark.parametrize("kernel", ["nearest", "lanczos"])
def test_plan_made_by_tasks(spark, kernel):
    dst = projected_grid(SRC, "EPSG:4326")
    a = plan_frame(spark, plan_reproject(SRC, dst, (7, 9), kernel)).orderBy("dst_r0", "dst_c0").collect()
    b = plan_table(spark, SRC, dst, (7, 9), kernel, tiles_per_task=5).orderBy("dst_r0", "dst_c0").collect()
    assert a == b and len(a) > 30
    with pytest.raises(ValueError, match="tile size"):
        plan_table(spark, SRC, dst, (0, 9))


def test_warp_with_either_plan(spark):
    px = spark.range(2000).selectExpr("cast(id div 50 as int) as row", "cast(id % 50 as int) as col", "cast(id as double) as v")
    tiles = RasterFrame(px, SRC, tile=(16, 16)).to_tiles().df
    dst = Grid("EPSG:32633", (60, 60), Affine(100, 0, 499030, 0, -100, 6600970))  # its rim lies outside the source
    one, two = ({(r["tile_row"], r["tile_col"]): bytes(r["data"]) for r in reproject_tiles(tiles, SRC, dst, "bilinear", -1.0, tile=(16, 16), dst_chunks=(8, 8), driver_plan=n).collect()} for n in (4096, 0))
    assert one == two and len(one) == 64
    blank = np.frombuffer(one[(0, 0)], "<f8")
    assert len(blank) == 64 and (blank == -1.0).all()
    with pytest.raises(ValueError, match="smaller dst_chunks"):
        reproject_tiles(tiles, SRC, dst, "bilinear", tile=(16, 16), max_bytes=64)
