"""Grids, projections, kernels and the two warp paths."""

import math

import numpy as np
import pytest

from gridspark.functions.crs import parse_crs
from gridspark.operators import kernels as K
from gridspark.operators import warp as W
from gridspark.operators.tiles import reproject_tiles, scanline_coords
from gridspark.plans.grid import Affine, Grid, projected_grid, transform
from gridspark.plans.planner import batch_size, blocks_per_tile, chunk_sizes, plan_reproject, source_coords
from gridspark.raster import RasterFrame, mosaic
from gridspark.sources.adapters import pixels_to_tiles, rasterise, read_tiles, tiles_to_pixels, write_tiles

UTM = Affine(100, 0, 500000, 0, -100, 6600000)


def frame(spark, a):
    return spark.createDataFrame([(i, j, None if v is None else float(v)) for i, row in enumerate(a) for j, v in enumerate(row)], "row int, col int, v double")


def grid_of(df, shape, name="v"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = r[name]
    return out


@pytest.mark.parametrize("crs, lon, lat", [
    ("EPSG:32633", 16.2, 48.3), ("EPSG:32733", 16.2, -48.3), ("EPSG:3857", 10, 50), ("EPSG:2154", 2.35, 48.85), ("EPSG:5070", -100, 40), ("EPSG:3031", 50, -80), ("EPSG:3413", -30, 80),
    ("EPSG:3395", 10, 50), ("EPSG:4087", 10, 50), ("EPSG:3577", 140, -25), ("+proj=sinu", 10, 50), ("+proj=lcc +lat_1=45 +lon_0=5", 7, 46), ("+proj=tmerc +lat_0=49 +lon_0=-2 +k=0.9996", -1, 52), ("+proj=utm +zone=33 +south", 15, -3),
])
def test_projections_return(crs, lon, lat):
    x, y = transform("EPSG:4326", crs, [lon], [lat])
    a, b = transform(crs, "EPSG:4326", x, y)
    assert abs(a[0] - lon) < 1e-10 and abs(b[0] - lat) < 1e-10


def test_projections_known_places():
    x, y = transform("EPSG:4326", "EPSG:32633", [15.0], [0.0])
    assert abs(x[0] - 500000) < 1e-6 and abs(y[0]) < 1e-6
    x, y = transform("EPSG:4326", "EPSG:3857", [180.0], [0.0])
    assert abs(x[0] - math.pi * 6378137) < 1e-6 and abs(y[0]) < 1e-6
    x, y = transform("EPSG:4326", "EPSG:2154", [3.0], [46.5])
    assert abs(x[0] - 700000) < 1e-6 and abs(y[0] - 6600000) < 1e-6
    assert np.abs(np.array(transform("EPSG:4326", "EPSG:3413", [0.0], [90.0]))).max() < 1e-6


@pytest.mark.parametrize("bad", ["EPSG:99999", "EPSG:x", "nonsense", "+proj=robin", "+proj=utm +zone=61", "+proj=stere +lat_0=52", "+proj=lcc"])
def test_unsupported_crs_is_named(bad):
    with pytest.raises(ValueError, match="not supported"):
        parse_crs(bad)


def test_affine():
    t = Affine(2, 0.5, 10, -0.25, -3, 20)
    assert np.allclose(t.inverse().forward(*t.forward(3.5, 7.25)), (3.5, 7.25))
    assert Affine.from_gdal(t.to_gdal()) == t
    assert math.isclose(Affine(1e-8, 0, 0, 0, -1e-8, 0).inverse().a, 1e8)
    with pytest.raises(ValueError, match="Singular"):
        Affine(1, 2, 0, 2, 4, 0).inverse()


def test_grid():
    g = Grid.from_bbox((0, 0, 30, 20), "EPSG:3857", resolution=10)
    assert g.shape == (2, 3) and g.bounds == (0, 0, 30, 20) and g.resolution == (10, 10)
    assert Grid.from_bbox((0, 0, 30, 20), "EPSG:3857", shape=(4, 3), resolution=1).shape == (4, 3)
    xs, ys = g.coords()
    assert Grid.from_coords(xs, ys, g.crs) == g and hash(g) == hash(Grid.from_coords(xs, ys, g.crs))
    with pytest.raises(ValueError):
        Grid.from_bbox((0, 0, 1, 1), "EPSG:3857")
    assert projected_grid(Grid("EPSG:32633", (40, 50), UTM), "EPSG:4326").crs == "EPSG:4326"


def test_plan():
    src = Grid("EPSG:32633", (64, 64), UTM)
    plan = plan_reproject(src, Grid("EPSG:32633", (64, 64), UTM.shifted(0.5, 0.5)), (32, 48))
    assert sum(p["h"] * p["w"] for p in plan) == 64 * 64 and all(p["has_data"] for p in plan)
    assert not any(p["has_data"] for p in plan_reproject(src, Grid("EPSG:4326", (8, 8), Affine(0.001, 0, -120, 0, -0.001, 10)), (4, 4)))
    assert chunk_sizes(10, 4) == [4, 4, 2] and blocks_per_tile(plan, (32, 32)) >= 1 and batch_size((512, 512), 1) == 1024
    with pytest.raises(ValueError):
        chunk_sizes(3, 0)


@pytest.mark.parametrize("kernel", K.KERNELS)
def test_kernels_keep_constants_and_lines(kernel):
    a = np.full((20, 20), 42.0)
    y, x = np.meshgrid(np.linspace(4, 15, 23), np.linspace(4, 15, 19), indexing="ij")
    v, ok = K.sample(a, x, y, kernel)
    assert ok.all() and np.allclose(v, 42)
    if kernel in ("bilinear", "cubic"):
        v, ok = K.sample(np.add.outer(3.0 * np.arange(20), 2.0 * np.arange(20)), x, y, kernel)
        assert np.allclose(v, 3 * (y - 0.5) + 2 * (x - 0.5))


def test_bad_taps():
    a = np.arange(64.0).reshape(8, 8)
    a[3, 3] = np.nan
    at = lambda k, nodata=None, b=a: [z[0] for z in K.sample(b, np.array([4.2]), np.array([4.2]), k, nodata)]
    assert not at("bilinear")[1] and at("lanczos")[1] and not at("cubic")[1]
    v, ok = K.sample(a, np.array([3.5]), np.array([3.5]), "nearest")
    assert ok[0] and np.isnan(v[0])  # NaN is a value for nearest
    b = np.arange(64.0).reshape(8, 8)
    b[3, 3] = -9999
    assert not K.sample(b, np.array([3.5]), np.array([3.5]), "nearest", -9999.0)[1][0]
    assert not K.sample(a, np.array([np.nan]), np.array([1.0]), "nearest")[1][0]


def test_types():
    v, ok = np.array([41.99999, -0.5, 300.7, np.nan]), np.ones(4, bool)
    assert K.typed(v, ok, "uint8", 7, "truncate").tolist() == [41, 0, 7, 7]
    assert K.typed(v, ok, "uint8", 7).tolist() == [42, 0, 255, 7]
    assert K.usable_nodata(-9999, "uint8") is None and K.fill_value(-9999, "uint8") == 0 and np.isnan(K.fill_value(None, "float32"))
    with pytest.raises(ValueError, match="Unsupported dtype"):
        K.checked_dtype("int64")
    with pytest.raises(ValueError, match="Unknown resampling"):
        K.kernel_name("mode")


@pytest.mark.parametrize("kernel", K.KERNELS)
@pytest.mark.parametrize("scale", [0.8, 4.0])
def test_paths_and_tilings_agree(spark, kernel, scale):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1000, (37, 41)).astype(float)
    src = Grid("EPSG:32633", a.shape, UTM)
    holes = [[None if rng.random() < 0.05 else v for v in row] for row in a]
    dst = Grid("EPSG:32633", (int(37 / scale), int(41 / scale)), Affine(100 * scale, 0, 500030, 0, -100 * scale, 6599980))
    px = frame(spark, holes)
    sql = grid_of(W.warp_pixels(px, src, dst, kernel, coord_decimals=6), dst.shape)
    rf = RasterFrame(px, src, tile=(16, 16)).to_tiles()
    outs = [grid_of(rf.reproject_match(dst, kernel, dst_chunks=c, coord_decimals=6).to_pixels().df, dst.shape) for c in ((5, 7), None)]
    whole, ok = K.sample(np.array([[np.nan if v is None else v for v in r] for r in holes]), *np.round(source_coords(src, dst, *np.meshgrid(np.arange(dst.cols) + 0.5, np.arange(dst.rows) + 0.5)), 6), kernel, None, K.scales(src.affine, dst.affine))
    want = np.where(ok, whole, np.nan)
    for got in (sql, *outs):
        assert np.allclose(got, want, equal_nan=True)


def test_cross_crs_with_nodata_fill_and_empty_tiles(spark):
    a = np.arange(400.0).reshape(20, 20)
    src = Grid("EPSG:32633", a.shape, UTM)
    dst = Grid("EPSG:4326", (30, 60), Affine(0.001, 0, 14.99, 0, -0.001, 59.55))
    rf = RasterFrame(frame(spark, a), src, nodata=-1.0, tile=(8, 8))
    sql = rf.reproject_match(dst, "bilinear", path="sql", coord_decimals=6)
    tile = rf.reproject_match(dst, "bilinear", path="tile", dst_chunks=(10, 10), coord_decimals=6)
    x, y = grid_of(sql.df, dst.shape), grid_of(tile.to_pixels().df, dst.shape)
    assert not np.isnan(x).any() and np.allclose(x, y) and (x == -1).any() and (x > 0).any()
    assert sql.grid == dst and sql.crs == "EPSG:4326" and sql.attrs["spatial_ref"] == "EPSG:4326"


def test_bands_types_and_store(spark, tmp_path):
    a = np.arange(144.0).reshape(12, 12)
    src = Grid("EPSG:3857", a.shape, Affine(10, 0, 0, 0, -10, 120))
    px = frame(spark, a).selectExpr("'a' as band", "*").unionByName(frame(spark, a + 50).selectExpr("'b' as band", "*"))
    rf = RasterFrame(px, src, "uint8", keys=("band",), tile=(5, 5)).to_tiles()
    write_tiles(rf.df, str(tmp_path / "store"))
    back = read_tiles(spark, str(tmp_path / "store"), (0, 0))
    assert back.count() == 6 and {r["r0"] for r in back.collect()} == {0}
    out = rf.reproject_match(Grid(src.crs, (6, 6), Affine(20, 0, 0, 0, -20, 120)), "average", dst_chunks=(4, 4)).to_pixels()
    for band, add in (("a", 0), ("b", 50)):
        got = grid_of(out.df.where(f"band = '{band}'"), (6, 6))
        assert np.array_equal(got, np.rint((a + add).reshape(6, 2, 6, 2).mean(axis=(1, 3))))
    again = tiles_to_pixels(pixels_to_tiles(px, src.shape, "float32", ("band",), (5, 5)), "float32", ("band",))
    assert again.count() == 288


def test_points_grids_and_mosaic(spark):
    pts = spark.createDataFrame([(1, 15.0, 60.0), (2, None, 3.0)], "id int, x double, y double")
    r = {x["id"]: x for x in W.transform_points(pts, "EPSG:4326", "EPSG:32633").collect()}
    assert abs(r[1]["x_out"] - 500000) < 1e-6 and r[2]["x_out"] is None
    src = Grid("EPSG:32633", (6, 6), UTM)
    assert W.transform_grid(spark, src, src).where("src_col <> col + 0.5").count() == 0
    a = np.arange(36.0).reshape(6, 6)
    one, two = RasterFrame(frame(spark, a).where("col < 3"), src), RasterFrame(frame(spark, a + 100), src)
    got = grid_of(mosaic(one, two).df, (6, 6))
    assert np.array_equal(got[:, :3], a[:, :3]) and np.array_equal(got[:, 3:], a[:, 3:] + 100)
    assert rasterise(frame(spark, a), W.F.lit(0), W.F.col("col"), W.F.col("v"), "avg").count() == 6
    at = W.transform_grid(spark, src, src)
    assert np.array_equal(grid_of(W.reproject_with_grid(frame(spark, a), src, at, src), (6, 6)), a)


def test_scanlines_stay_near(spark):
    src = Grid("EPSG:32633", (64, 64), UTM)
    dst = projected_grid(src, "EPSG:4326")
    x, y = scanline_coords(src, dst, 0, 0, *dst.shape, 0.125)
    c, r = source_coords(src, dst, *np.meshgrid(np.arange(dst.cols) + 0.5, np.arange(dst.rows) + 0.5))
    assert max(np.abs(x - c).max(), np.abs(y - r).max()) < 0.15


def test_streaming_points(spark, tmp_path):
    spark.createDataFrame([(1, 15.0, 60.0)], "id int, x double, y double").write.parquet(str(tmp_path / "in"))
    from gridspark.streaming.points import stream_points

    q = stream_points(spark.readStream.schema("id int, x double, y double").parquet(str(tmp_path / "in")), "EPSG:4326", "EPSG:3857").writeStream.format("memory").queryName("pts").start()
    q.processAllAvailable()
    q.stop()
    assert abs(spark.table("pts").first()["x_out"] - 1669792.3618991) < 1e-6


def test_large_windows_are_refused(spark):
    src = Grid("EPSG:32633", (4000, 4000), UTM)
    with pytest.raises(ValueError, match="dst_chunks"):
        reproject_tiles(None, src, Grid("EPSG:32633", (4, 4), Affine(100000, 0, 500000, 0, -100000, 6600000)), dst_chunks=None, max_bytes=1 << 20)


def test_crs_of_metadata():
    from gridspark.functions.crs import crs_of, parse_crs

    wkt2 = 'PROJCRS["WGS 84 / UTM zone 33N",BASEGEOGCRS["WGS 84",ID["EPSG",4326]],CONVERSION["UTM zone 33N"],ID["EPSG",32633]]'
    wkt1 = 'GEOGCS["WGS 84",DATUM["WGS_1984",AUTHORITY["EPSG","6326"]],AUTHORITY["EPSG","4326"]]'
    assert crs_of({"crs": "EPSG:4326"}, {"epsg": 32633, "crs_wkt": wkt1}) == "EPSG:32633"
    assert crs_of({"crs": "EPSG:3857"}, {"crs_wkt": wkt1}) == "EPSG:4326" and crs_of({"crs": wkt2}) == "EPSG:32633" and crs_of({"crs": "+proj=sinu"}) == "+proj=sinu"
    assert parse_crs(wkt2) == parse_crs("EPSG:32633")
    with pytest.raises(ValueError, match="no CRS"):
        crs_of({}, {})
    with pytest.raises(ValueError, match="not supported"):
        parse_crs('PROJCRS["mine"]')


def test_raster_set(spark):
    from types import SimpleNamespace

    from gridspark.raster import RasterFrame, RasterSet

    src = Grid("EPSG:32633", (40, 30), Affine(100, 0, 500000, 0, -100, 6600000))
    px = spark.range(1200).selectExpr("cast(id div 30 as int) as row", "cast(id % 30 as int) as col", "cast(id as double) as v")
    times = spark.createDataFrame([(1,), (2,)], "time int")
    rs = RasterSet.of(
        {"a": RasterFrame(px, src, attrs={"unit": "m", "crs": "old"}), "b": RasterFrame(px.selectExpr("row", "col", "v * 2 as v"), src), "c": RasterFrame(px.selectExpr("row", "col", "cast(v % 200 as smallint) as v"), src, "uint8", nodata=7)},
        {"times": times}, {"title": "x", "transform": "old"},
    )
    assert len(rs.groups) == 2 and rs.grid == src
    dst = Grid("EPSG:4326", (20, 25), Affine(0.002, 0, 15.0, 0, -0.0015, 59.535))
    box = SimpleNamespace(crs=dst.crs, shape=SimpleNamespace(y=20, x=25), affine=dst.affine)
    for options in ({}, {"path": "tile", "dst_chunks": (8, 8)}):
        out = rs.reproject_match(box, "bilinear", **options)
        assert out.grid == dst and out.others["times"] is times and out.attrs["title"] == "x" and "transform" not in out.attrs
        assert out["a"].attrs["unit"] == "m" and out["a"].attrs["spatial_ref_attrs"]["epsg"] == 4326 and "crs" not in out["a"].attrs
        for n in "abc":
            alone = rs[n].reproject_match(dst, "bilinear", **options).to_pixels().df
            values = lambda df: sorted((r["row"], r["col"], str(round(float(r["v"]), 6))) for r in df.collect())
            assert values(out[n].to_pixels().df) == values(alone)
    near = rs["a"].reproject_match(dst, "bilinear", error_threshold=0.125)
    exact = rs["a"].reproject_match(dst, "bilinear", path="tile")
    both = near.to_pixels().df.withColumnRenamed("v", "w").join(exact.to_pixels().df, ["row", "col"]).where("not isnan(v) and not isnan(w)")
    assert near.layout == "tiles" and both.count() > 100 and both.selectExpr("max(abs(v - w))").first()[0] < 0.13 * 31
    with pytest.raises(ValueError, match="exact"):
        rs["a"].reproject_match(dst, path="sql", error_threshold=0.1)
    with pytest.raises(TypeError, match="a grid is needed"):
        rs["a"].reproject_match(3)
    with pytest.raises(KeyError):
        rs["d"]


def test_windows_reach_the_scan(spark, tmp_path):
    from gridspark.plans.planner import footprint, source_window
    from gridspark.raster import RasterFrame

    src = Grid("EPSG:32633", (400, 400), Affine(100, 0, 500000, 0, -100, 6600000))
    dst = Grid("EPSG:32633", (20, 20), Affine(100, 0, 510000, 0, -100, 6590000))
    assert source_window(src, dst, "bilinear") is not None and footprint(src, dst, "bilinear") == (0, 20, 0, 20)
    px = spark.range(160000).selectExpr("cast(id div 400 as int) as row", "cast(id % 400 as int) as col", "cast(id as double) as v")
    px.write.parquet(str(tmp_path / "px"))
    rf = RasterFrame(spark.read.parquet(str(tmp_path / "px")), src, tile=(50, 50))
    out = rf.reproject_match(dst, "bilinear", fill=False)
    plan = out.df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(row,97), LessThanOrEqual(row,123)" in plan
    assert out.df.count() == 400
    from gridspark.sources.adapters import read_tiles, write_tiles

    write_tiles(rf.to_tiles().df, str(tmp_path / "tiles"))
    stored = RasterFrame(read_tiles(spark, str(tmp_path / "tiles")), src, tile=(50, 50), layout="tiles")
    warped = stored.reproject_match(dst, "bilinear", dst_chunks=(10, 10))
    plan = warped.df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "tile_row" in plan.split("PartitionFilters: [")[1].split("]")[0]
    values = lambda df: sorted((r["row"], r["col"], round(r["v"], 6)) for r in df.collect())
    assert values(warped.to_pixels().df) == values(out.df)
    far = Grid("EPSG:32633", (20, 20), Affine(100, 0, 900000, 0, -100, 6590000))
    assert footprint(src, far, "bilinear")[3] == 0 or footprint(src, far, "bilinear")[3] <= footprint(src, far, "bilinear")[2]


def test_bands_share_groups(spark):
    from gridspark.raster import RasterFrame

    src = Grid("EPSG:32633", (32, 32), Affine(100, 0, 500000, 0, -100, 6600000))
    px = spark.range(1024 * 6).selectExpr("cast(id % 6 as int) as band", "cast(id div 6 div 32 as int) as row", "cast(id div 6 % 32 as int) as col", "cast(id as double) as v")
    rf = RasterFrame(px, src, keys=("band",), tile=(16, 16)).to_tiles()
    dst = Grid(src.crs, src.shape, src.affine.shifted(0.3, 0.7))
    every = [sorted(map(str, reproject_tiles(rf.df, src, dst, keys=("band",), tile=(16, 16), dst_chunks=(16, 16), max_bytes=m).collect())) for m in (1 << 28, 20_000)]
    assert every[0] == every[1] and len(every[0]) == 24
