"""The query catalogue: driver tables as rasters, every operator once or more, and each query's SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions.exprs import lit, run_frame, run_sql
from gridspark.operators import warp as W
from gridspark.plans.grid import Affine, Grid, boundary, projected_grid
from gridspark.plans.planner import blocks_per_tile, plan_frame, plan_reproject
from gridspark.operators.kernels import reach, scales
from gridspark.raster import RasterFrame, RasterSet, mosaic
from gridspark.sources.adapters import keyed_pixels, rasterise

KERNELS = ("nearest", "bilinear", "cubic", "lanczos", "average")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: table -> key, value, width, CRS, affine.  Keys are dense from 0, so that width makes them a raster.
RASTERS = {
    "orders": ("o_orderkey", "o_totalprice", 150, "EPSG:32633", Affine(100, 0, 500000, 0, -100, 6600000)),
    "events": ("event_id", "value", 100, "EPSG:3857", Affine(1000, 0, 1600000, 0, -1000, 8300000)),
    "part": ("p_partkey", "p_retailprice", 20, "EPSG:32633", Affine(50, 0, 500000, 0, -100, 6600000)),
    "customer": ("c_custkey", "c_acctbal", 15, "EPSG:4326", Affine(0.01, 0, 15, 0, -0.01, 60)),
}
ROWS = {"orders": 100, "events": 100, "part": 100, "customer": 100}  # rows at sf0.01, which the SQL texts are written for


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_grid(spark: SparkSession, sf_dir: str, name: str) -> Grid:
    key, _, width, crs, affine = RASTERS[name]
    last = read(spark, sf_dir, name).agg(F.max(key)).first()[0]
    return Grid(crs, (int(last) // width + 1, width), affine)


def fixed_grid(name: str) -> Grid:
    """The grid of sf0.01, which the SQL texts are written for."""
    _, _, width, crs, affine = RASTERS[name]
    return Grid(crs, (ROWS[name], width), affine)


def pixels(spark: SparkSession, sf_dir: str, name: str, value: str | None = None) -> DataFrame:
    key, v, width, *_ = RASTERS[name]
    return keyed_pixels(read(spark, sf_dir, name), key, F.expr(value or v), width)


def pixels_sql(name: str, value: str | None = None, more: str = "") -> str:
    key, v, width, *_ = RASTERS[name]
    return f"select {more}cast(floor({key} / {lit(width)}) as int) as tr, cast({key} % {width} as int) as tc, cast({value or v} as double) as v from {name}"


def rounded(df: DataFrame, decimals: int = 4) -> DataFrame:
    """v by the rule of the SQL's round: scaled, half away from zero, scaled back.  Spark's own rounds the shortest decimal text."""
    if dict(df.dtypes)["v"] not in ("double", "float"):
        return df
    v, k = F.col("v").cast("double"), F.lit(10.0**decimals)
    near = F.round(v * k) / k
    return df.withColumn("v", F.when(F.abs(near) < F.lit(float("inf")), near).otherwise(v) + F.lit(0.0))


def register(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def add_warp(name: str, table: str, dst, kernel: str, nodata: float | None = None, dtype: str = "float64", rounding: str = "round", value: str | None = None, decimals: int = 4) -> None:
    """dst: a function from the source grid to the destination grid, so that both follow the table's size."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        src = source_grid(spark, sf_dir, table)
        return rounded(W.warp_pixels(pixels(spark, sf_dir, table, value), src, dst(src), kernel, nodata, dtype, rounding, coord_decimals=4), decimals)

    src = fixed_grid(table)
    register(name, query, W.warp_sql(pixels_sql(table, value), src, dst(src), kernel, nodata, dtype, rounding, coord_decimals=4, out_decimals=decimals))


# ---- affine and grids ---------------------------------------------------------------------------

_T = RASTERS["orders"][4]
_R, _C = "cast(floor(o_orderkey / 150e0) as int)", "cast(o_orderkey % 150 as int)"
_ROTATED = Affine(80, 20, 500000, 15, -90, 6600000)


def _affine(t: Affine, inverse: bool, both: bool = False):
    ahead = W.affine_steps(t, f"({_C} + 0.5e0)", f"({_R} + 0.5e0)", "ax", "ay")
    back = W.affine_steps(t.inverse(), "ax", "ay", "bc", "br") if inverse or both else []
    cols = [("x", "ax"), ("y", "ay")] if not inverse else [("src_col", "bc"), ("src_row", "br")]
    cols = cols + [("src_col", "bc"), ("src_row", "br")] if both else cols

    def query(spark, sf_dir):
        df = run_frame(ahead + back, read(spark, sf_dir, "orders"))
        return df.select("o_orderkey", *(F.round(b, 6).alias(a) for a, b in cols))

    return query, f"select o_orderkey, {', '.join(f'round({b}, 6) as {a}' for a, b in cols)} from {run_sql(ahead + back, 'orders')}"


register("affine_forward", *_affine(_ROTATED, False))
register("affine_inverse", *_affine(_ROTATED, True))
register("affine_roundtrip", *_affine(_T, False, both=True))


def _grid_coords(spark, sf_dir):
    g = source_grid(spark, sf_dir, "orders")
    xs, ys = g.coords()
    return spark.createDataFrame([("x", i, float(v)) for i, v in enumerate(xs)] + [("y", i, float(v)) for i, v in enumerate(ys)], "axis string, i int, v double")


register(
    "grid_coords", _grid_coords,
    "select 'x' as axis, cast(i as int) as i, 500000 + 100 * (i + 0.5e0) as v from range(150) t(i) union all select 'y', cast(i as int), 6600000 - 100 * (i + 0.5e0) from (select unnest(range((select max(o_orderkey) // 150 + 1 from orders))) as i)",
)


def _grid_bounds(spark, sf_dir):
    g = source_grid(spark, sf_dir, "orders")
    return spark.createDataFrame([(*g.bounds, *g.resolution, g.rows, g.cols)], "minx double, miny double, maxx double, maxy double, resx double, resy double, nrows int, ncols int")


register("grid_bounds", _grid_bounds, "select 500000e0 as minx, 6600000 - 100e0 * n as miny, 515000e0 as maxx, 6600000e0 as maxy, 100e0 as resx, 100e0 as resy, cast(n as int) as nrows, 150 as ncols from (select max(o_orderkey) // 150 + 1 as n from orders)")


def _from_bbox(spark, sf_dir):
    b = source_grid(spark, sf_dir, "orders").bounds
    out = [("shape", Grid.from_bbox(b, "EPSG:32633", shape=(10, 30))), ("resolution", Grid.from_bbox(b, "EPSG:32633", resolution=(400.0, 250.0)))]
    return spark.createDataFrame([(n, g.rows, g.cols, g.affine.a, g.affine.c, g.affine.e, g.affine.f) for n, g in out], "how string, nrows int, ncols int, a double, c double, e double, f double")


register(
    "grid_from_bbox", _from_bbox,
    "select 'shape' as how, 10 as nrows, 30 as ncols, 500e0 as a, 500000e0 as c, -(100e0 * n) / 10 as e, 6600000e0 as f from (select max(o_orderkey) // 150 + 1 as n from orders) "
    "union all select 'resolution', cast(greatest(1, round_even(100e0 * n / 250, 0)) as int), cast(round_even(15000e0 / 400, 0) as int), 400e0, 500000e0, -250e0, 6600000e0 from (select max(o_orderkey) // 150 + 1 as n from orders)",
)


def _infer(spark, sf_dir):
    g = projected_grid(source_grid(spark, sf_dir, "orders"), "EPSG:4326")
    return spark.createDataFrame([(g.rows, g.cols, round(g.affine.a, 8), round(g.affine.c, 8), round(g.affine.e, 8), round(g.affine.f, 8))], "nrows int, ncols int, a double, c double, e double, f double")


def _infer_sql() -> str:
    g = fixed_grid("orders")
    x, y = boundary(*g.bounds)
    points = ", ".join(f"({lit(a)}, {lit(b)})" for a, b in zip(x, y, strict=True))
    steps, u, v = W.between("EPSG:32633", "EPSG:4326", "x", "y")
    box = f"select min({u}) as l, max({u}) as r, min({v}) as b, max({v}) as t from {run_sql(steps, f'(select x, y from (values {points}) p(x, y))')}"
    n = g.rows * g.cols
    cols = f"(select *, greatest(1, round_even(sqrt({n} * (r - l) / (t - b)), 0)) as nc from ({box}))"
    grid = f"(select *, greatest(1, round_even({n} / nc, 0)) as nr from {cols})"
    return f"select cast(nr as int) as nrows, cast(nc as int) as ncols, round((r - l) / nc, 8) as a, round(l, 8) as c, round((b - t) / nr, 8) as e, round(t, 8) as f from {grid}"


register("infer_dst_grid_auto", _infer, _infer_sql())

# ---- points -------------------------------------------------------------------------------------

_LONLAT = {
    "orders": ("o_orderkey", "(8e0 + 15e0 * ((o_orderkey * 37) % 1000) / 1000e0)", "(40e0 + 20e0 * ((o_orderkey * 61) % 1000) / 1000e0)"),
    "customer": ("c_custkey", "(-10e0 + 30e0 * ((c_custkey * 37) % 500) / 500e0)", "(35e0 + 25e0 * ((c_custkey * 61) % 500) / 500e0)"),
}
_AREAS = {  # where a CRS is at home: longitude and latitude shifted there
    "EPSG:5070": ("(x - 100e0)", "(y - 8e0)"), "EPSG:3031": ("(x * 5e0)", "(0e0 - y - 30e0)"), "EPSG:3413": ("(x * 5e0)", "(y + 25e0)"), "EPSG:32733": ("x", "(0e0 - y)"),
}


def add_points(name: str, table: str, src: str, dst: str) -> None:
    """Points of the table, in `src` coordinates (made from longitudes and latitudes where src is projected)."""
    key, lon, lat = _LONLAT[table]
    home = src if src != "EPSG:4326" else dst
    ax, ay = _AREAS.get(home, ("x", "y"))
    made = [("x", lon), ("y", lat), ("x1", ax), ("y1", ay)]
    start, u, v = W.between("EPSG:4326", src, "x1", "y1", "m")
    made = [*made, *start, ("px", f"round({u}, 3)" if src != "EPSG:4326" else u), ("py", f"round({v}, 3)" if src != "EPSG:4326" else v)]
    decimals = 9 if dst == "EPSG:4326" else 4

    def query(spark, sf_dir):
        df = run_frame(made, read(spark, sf_dir, table)).select(key, "px", "py")
        out = W.transform_points(df, src, dst, "px", "py", ("x_out", "y_out"))
        return out.select(key, *(F.round(c, decimals).alias(c) for c in ("x_out", "y_out")))

    register(name, query, W.transform_points_sql(f"(select {key}, px, py from {run_sql(made, table)})", key, src, dst, "px", "py", ("x_out", "y_out"), decimals))


for _n, _t, _a, _b in (
    ("tp_4326_3857", "orders", "EPSG:4326", "EPSG:3857"), ("tp_3857_4326", "orders", "EPSG:3857", "EPSG:4326"), ("tp_4326_utm33", "orders", "EPSG:4326", "EPSG:32633"),
    ("tp_4326_utm_south", "orders", "EPSG:4326", "EPSG:32733"), ("tp_utm33_4326", "orders", "EPSG:32633", "EPSG:4326"), ("tp_utm33_3857", "orders", "EPSG:32633", "EPSG:3857"),
    ("tp_4326_2154", "customer", "EPSG:4326", "EPSG:2154"), ("tp_4326_5070", "customer", "EPSG:4326", "EPSG:5070"), ("tp_4326_3031", "customer", "EPSG:4326", "EPSG:3031"), ("tp_4326_3413", "customer", "EPSG:4326", "EPSG:3413"),
    ("tp_2154_4326", "customer", "EPSG:2154", "EPSG:4326"), ("tp_5070_4326", "customer", "EPSG:5070", "EPSG:4326"), ("tp_3031_4326", "customer", "EPSG:3031", "EPSG:4326"), ("tp_3413_4326", "customer", "EPSG:3413", "EPSG:4326"),
    ("tp_sinusoidal", "customer", "EPSG:4326", "+proj=sinu +lon_0=5"), ("tp_equirect", "customer", "EPSG:4326", "+proj=eqc +lat_ts=45"), ("tp_mercator_ell", "customer", "EPSG:4326", "EPSG:3395"),
    ("tp_albers_feet", "customer", "EPSG:4326", "+proj=aea +lat_1=29.5 +lat_2=45.5 +lat_0=23 +lon_0=5 +ellps=clrk66 +units=us-ft"), ("tp_lcc_feet_inverse", "customer", "+proj=lcc +lat_1=40 +lat_2=55 +lat_0=45 +lon_0=5 +ellps=intl +units=ft", "EPSG:4326"),
    ("tp_double_stereographic", "customer", "EPSG:4326", "+proj=sterea +lat_0=52 +lon_0=5 +k_0=0.9999079 +x_0=155000 +y_0=463000 +ellps=bessel"),
    ("tp_mercator_ell_inverse", "customer", "EPSG:3395", "EPSG:4326"), ("tp_lcc_1sp", "customer", "EPSG:4326", "+proj=lcc +lat_1=46.5 +lat_0=46.5 +lon_0=3 +k_0=0.9998 +x_0=600000 +y_0=2200000"),
):
    add_points(_n, _t, _a, _b)

# ---- warps --------------------------------------------------------------------------------------


def _lonlat_of(src: Grid) -> Grid:
    """A fixed pixel size in degrees over the source's upper left."""
    step = {"EPSG:32633": (15.0, 59.54, 0.00176, 0.0009), "EPSG:3857": (14.38, 59.6, 0.009, 0.0045)}[src.crs]
    return Grid("EPSG:4326", src.shape, Affine(step[2], 0, step[0], 0, -step[3], step[1]))


def _shift(src: Grid) -> Grid:
    return Grid(src.crs, src.shape, src.affine.shifted(0.3, 0.7))


def _scaled(k: float, off: float = 0.0):
    return lambda s: Grid(s.crs, (max(1, int(s.rows / k)), max(1, int(s.cols / k))), Affine(s.affine.a * k, 0, s.affine.c + off, 0, s.affine.e * k, s.affine.f - off))


def _mercator_of(src: Grid) -> Grid:
    return Grid("EPSG:3857", src.shape, Affine(1113.0, 0, 1669500.0, 0, -2226.0, 8399900.0))


for _k in KERNELS:
    add_warp(f"warp_{_k}_utm33_to_4326", "orders", _lonlat_of, _k)
    add_warp(f"warp_nodata_sentinel_{_k}", "customer", _shift, _k, nodata=-9999.0, value="case when c_acctbal < 0 then -9999e0 else c_acctbal end")
    add_warp(f"warp_null_{_k}", "customer", _shift, _k, value="case when c_acctbal < 0 then null else c_acctbal end")
    if _k != "average":
        add_warp(f"warp_{_k}_same_crs_shift", "orders", _shift, _k)
for _n, _s, _o in (("down2", 2, 0.0), ("down4", 4, 0.0), ("frac", 2.5, 30.0)):
    add_warp(f"warp_average_{_n}", "orders", _scaled(_s, _o), "average", decimals=6)
add_warp("warp_bilinear_3857_to_4326", "events", _lonlat_of, "bilinear")
add_warp("warp_nearest_4326_to_3857", "customer", _mercator_of, "nearest")
add_warp("warp_uint8_nearest", "part", _shift, "nearest", dtype="uint8", value="p_size")
add_warp("warp_uint8_bilinear_trunc", "part", _shift, "bilinear", dtype="uint8", rounding="truncate", value="p_size")
add_warp("warp_uint8_bilinear_round", "part", _shift, "bilinear", dtype="uint8", value="p_size")
add_warp("warp_int8_cubic_round", "part", _shift, "cubic", dtype="int8", value="p_size * 2")
add_warp("warp_upscale_4x", "part", _scaled(0.25), "bilinear")
add_warp("warp_nonsquare", "part", lambda s: Grid(s.crs, (s.rows, s.cols), Affine(40, 0, 500010, 0, -130, 6599980)), "cubic")
add_warp("warp_southup", "part", lambda s: Grid(s.crs, s.shape, Affine(50, 0, 500010, 0, 100, 6600000 - 100.0 * s.rows)), "bilinear")
add_warp("warp_rotated", "part", lambda s: Grid(s.crs, s.shape, Affine(45, 12, 500000, -20, -90, 6600000)), "lanczos")
add_warp("warp_match_grid", "orders", lambda s: Grid(s.crs, (s.rows, 40), Affine(50, 0, 500000, 0, -100, 6600000)), "bilinear")


def add_filled() -> None:
    def query(spark, sf_dir):
        src = source_grid(spark, sf_dir, "customer")
        return rounded(W.warp_pixels(pixels(spark, sf_dir, "customer"), src, _shift(src), "bilinear", -1.0, coord_decimals=4, fill=True))

    src = fixed_grid("customer")
    inner = W.warp_sql(pixels_sql("customer"), src, _shift(src), "bilinear", -1.0, coord_decimals=4, out_decimals=4)
    register("warp_filled", query, f'select r as "row", c as col, coalesce(v, -1e0) as v from (select cast(i // 15 as int) as r, cast(i % 15 as int) as c from range({src.rows * src.cols}) t(i)) left join ({inner}) w on w."row" = r and w.col = c')


add_filled()


def add_grids() -> None:
    for name, table in (("tgrid_utm33_to_4326", "orders"), ("tgrid_3857_to_4326", "events")):
        def query(spark, sf_dir, table=table):
            src = source_grid(spark, sf_dir, table)
            return W.transform_grid(spark, src, _lonlat_of(src), 4)

        src = fixed_grid(table)
        dst = _lonlat_of(src)
        cells = f"(select cast(floor(i / {lit(dst.cols)}) as int) as r, cast(i % {dst.cols} as int) as c from range({dst.rows * dst.cols}) t(i))"
        register(name, query, f'select r as "row", c as col, sc as src_col, sr as src_row from {run_sql(W.coordinate_steps(src, dst, 4), cells)}')


add_grids()


def add_with_grid() -> None:
    """Source coordinates from a table of their own: each event pixel looks a little off its place."""
    sc, sr = "(event_id % 100) + 0.5e0 + round(((event_id * 31) % 17) / 7e0, 4)", "floor(event_id / 100e0) + 0.5e0 - round(((event_id * 13) % 11) / 5e0, 4)"

    def query(spark, sf_dir):
        src = source_grid(spark, sf_dir, "events")
        at = read(spark, sf_dir, "events").select(F.expr("cast(floor(event_id / 100e0) as int)").alias("row"), F.expr("cast(event_id % 100 as int)").alias("col"), F.expr(sc).alias("src_col"), F.expr(sr).alias("src_row"))
        return rounded(W.reproject_with_grid(pixels(spark, sf_dir, "events"), src, at, src, "cubic"))

    src = fixed_grid("events")
    at = f"select cast(floor(event_id / 100e0) as int) as r, cast(event_id % 100 as int) as c, {sc} as sc, {sr} as sr from events"
    register("warp_with_grid", query, W.warp_sql(pixels_sql("events"), src, src, "cubic", coords=at, out_decimals=4))


add_with_grid()


def add_multiband() -> None:
    affine = Affine(100, 0, 500000, 0, -100, 6600000)

    def query(spark, sf_dir):
        e = read(spark, sf_dir, "embeddings")
        rows = int(e.agg(F.max("vec_id")).first()[0]) // 20 + 1
        src = Grid("EPSG:32633", (rows, 20), affine)
        px = e.select(F.floor(F.col("vec_id") / 20).cast("int").alias("row"), (F.col("vec_id") % 20).cast("int").alias("col"), F.posexplode("embedding").alias("band", "v"))
        return rounded(W.warp_pixels(px, src, _shift(src), "bilinear", keys=("band",), coord_decimals=4))

    src = Grid("EPSG:32633", (25, 20), affine)
    px = "select cast(floor(vec_id / 20e0) as int) as tr, cast(vec_id % 20 as int) as tc, cast(unnest(range(len(embedding))) as int) as band, cast(unnest(embedding) as double) as v from embeddings"
    register("warp_multiband_64", query, W.warp_sql(px, src, _shift(src), "bilinear", keys=("band",), coord_decimals=4, out_decimals=4))


add_multiband()


def add_tile_path() -> None:
    for k in KERNELS:
        def query(spark, sf_dir, k=k):
            src = source_grid(spark, sf_dir, "orders")
            rf = RasterFrame(pixels(spark, sf_dir, "orders"), src, tile=(64, 64)).to_tiles()
            out = rf.reproject_match(_lonlat_of(src), k, dst_chunks=(48, 40), coord_decimals=4).to_pixels().df
            return rounded(out.where("not isnan(v)").select("row", "col", "v"))

        register(f"tile_{k}_utm33_to_4326", query, ORACLES[f"warp_{k}_utm33_to_4326"])

    def average(spark, sf_dir):
        src = source_grid(spark, sf_dir, "orders")
        rf = RasterFrame(pixels(spark, sf_dir, "orders"), src, tile=(32, 32)).to_tiles()
        return rounded(rf.reproject_match(_scaled(4)(src), "average", dst_chunks=(4, 4), coord_decimals=4).to_pixels().df.where("not isnan(v)"), 6)

    register("tile_average_down4_chunked", average, ORACLES["warp_average_down4"])


add_tile_path()


def _plan(name: str, dst, chunks: tuple[int, int], kernel: str, sql: str | None = None) -> None:
    def query(spark, sf_dir):
        src = source_grid(spark, sf_dir, "orders")
        plan = plan_reproject(src, dst(src), chunks, kernel)
        return plan_frame(spark, plan).select("dst_r0", "dst_r1", "dst_c0", "dst_c1", "src_r0", "src_r1", "src_c0", "src_c1", "h", "w", "has_data")

    register(name, query, sql)


def _same_crs_plan_sql() -> str:
    """Slices of the shifted same-CRS plan in closed form: halo 1, one pixel more on each side."""
    n = "(select max(o_orderkey) // 150 + 1 as n from orders)"
    tiles = f"(select n, unnest(range(0, n, 32)) as r0 from {n})"
    both = f"(select n, r0, least(r0 + 32, n) as r1, unnest(range(0, 150, 64)) as c0 from {tiles})"
    full = f"(select *, least(c0 + 64, 150) as c1 from {both})"
    return (
        "select cast(r0 as int) as dst_r0, cast(r1 as int) as dst_r1, cast(c0 as int) as dst_c0, cast(c1 as int) as dst_c1, "
        "cast(greatest(0, floor(r0 + 0.7e0 - 1) - 1) as int) as src_r0, cast(least(n, ceil(r1 + 0.7e0 + 1) + 1) as int) as src_r1, "
        "cast(greatest(0, floor(c0 + 0.3e0 - 1) - 1) as int) as src_c0, cast(least(150, ceil(c1 + 0.3e0 + 1) + 1) as int) as src_c1, "
        f"cast(r1 - r0 as int) as h, cast(c1 - c0 as int) as w, true as has_data from {full}"
    )


_plan("plan_tiles_same_crs", _shift, (32, 64), "bilinear", _same_crs_plan_sql())


def _cross_crs_plan_sql(chunks: tuple[int, int], kernel: str) -> str:
    """Each tile's rim (21 points a side) and 5 x 5 lattice, projected one by one; the halo is the kernel's reach."""
    src = fixed_grid("orders")
    dst = _lonlat_of(src)
    th, tw = chunks
    rim = [(i / 20, e) for i in range(21) for e in (0, 1)]
    at = ", ".join(f"({lit(u)}, {lit(v)})" for u, v in dict.fromkeys([*rim, *((v, u) for u, v in rim), *(((i + 1) / 6, (j + 1) / 6) for i in range(5) for j in range(5))]))
    tiles = f"(select r0, least(r0 + {th}, {dst.rows}) as r1, c0, least(c0 + {tw}, {dst.cols}) as c1 from (select unnest(range(0, {dst.rows}, {th})) as r0), (select unnest(range(0, {dst.cols}, {tw})) as c0))"
    points = f"(select r0, r1, c0, c1, c0 + (c1 - c0) * u as pc, r0 + (r1 - r0) * w as pr from {tiles}, (values {at}) p(u, w))"
    steps, x, y = W.between(dst.crs, src.crs, "gx", "gy")
    steps = W.affine_steps(dst.affine, "pc", "pr", "gx", "gy") + steps + W.affine_steps(src.affine.inverse(), x, y, "sc", "sr")
    rx, ry = reach(kernel, scales(src.affine, dst.affine))
    slices = ", ".join(f"cast(least(greatest({f}({g}({v}) {s} {lit(halo)}) {s} 1, 0), {n}) as int) as src_{v[1]}{k}" for v, halo, n in (("sr", ry, src.rows), ("sc", rx, src.cols)) for k, f, g, s in ((0, "floor", "min", "-"), (1, "ceil", "max", "+")))
    found = f"(select r0, r1, c0, c1, {slices} from {run_sql(steps, points)} group by r0, r1, c0, c1)"
    full = f"(select *, src_r1 > src_r0 and src_c1 > src_c0 as has_data from {found})"
    cut = ", ".join(f"case when has_data then {k} else 0 end as {k}" for k in ("src_r0", "src_r1", "src_c0", "src_c1"))
    return f"select cast(r0 as int) as dst_r0, cast(r1 as int) as dst_r1, cast(c0 as int) as dst_c0, cast(c1 as int) as dst_c1, {cut}, cast(r1 - r0 as int) as h, cast(c1 - c0 as int) as w, has_data from {full}"


_plan("plan_tiles_cross_crs", _lonlat_of, (32, 64), "lanczos", _cross_crs_plan_sql((32, 64), "lanczos"))
_plan(
    "plan_tiles_disjoint", lambda s: Grid("EPSG:32633", (64, 64), Affine(100, 0, 900000, 0, -100, 6600000)), (32, 32), "bilinear",
    "select cast(r * 32 as int) as dst_r0, cast(r * 32 + 32 as int) as dst_r1, cast(c * 32 as int) as dst_c0, cast(c * 32 + 32 as int) as dst_c1, 0 as src_r0, 0 as src_r1, 0 as src_c0, 0 as src_c1, 32 as h, 32 as w, false as has_data from range(2) a(r), range(2) b(c)",
)


def _overlap(spark, sf_dir):
    """Source blocks of 32 x 32 that each destination tile reads, as an equi-join after explode."""
    src = source_grid(spark, sf_dir, "orders")
    plan = plan_frame(spark, plan_reproject(src, _shift(src), (32, 64), "bilinear")).where("has_data")
    need = plan.withColumn("block_row", F.explode(F.expr("sequence(src_r0 div 32, (src_r1 - 1) div 32)"))).withColumn("block_col", F.explode(F.expr("sequence(src_c0 div 32, (src_c1 - 1) div 32)")))
    return need.select("dst_r0", "dst_c0", F.col("block_row").cast("int").alias("block_row"), F.col("block_col").cast("int").alias("block_col"))


register(
    "plan_block_overlap", _overlap,
    f"select dst_r0, dst_c0, cast(br as int) as block_row, cast(bc as int) as block_col from ({_same_crs_plan_sql()}) p, (select unnest(range((select max(o_orderkey) // 150 + 1 from orders) // 32 + 1)) as br), range(5) c(bc) "
    "where br * 32 < src_r1 and br * 32 + 32 > src_r0 and bc * 32 < src_c1 and bc * 32 + 32 > src_c0",
)


def _bound(spark, sf_dir):
    src = source_grid(spark, sf_dir, "orders")
    return spark.createDataFrame([(blocks_per_tile(plan_reproject(src, _shift(src), (32, 64), "bilinear"), (32, 32)),)], "most_blocks int")


register("plan_most_blocks", _bound, f"select cast(max(n) as int) as most_blocks from (select count(*) as n from ({ORACLES['plan_block_overlap']}) group by dst_r0, dst_c0)")

register(
    "rasterize_lineitem_sum",
    lambda spark, d: rounded(rasterise(read(spark, d, "lineitem"), F.expr("floor(l_partkey / 50e0)"), F.expr("floor(l_suppkey / 5e0)"), F.col("l_extendedprice"), "sum"), 2),
    'select cast(floor(l_partkey / 50e0) as int) as "row", cast(floor(l_suppkey / 5e0) as int) as col, round(sum(l_extendedprice), 2) as v from lineitem group by 1, 2',
)


def add_dataset() -> None:
    """Variables of two types, each group of one type warped at once; a table without both dimensions passes through."""

    def query(spark, sf_dir):
        src = source_grid(spark, sf_dir, "part")
        of = lambda v, dtype: RasterFrame(pixels(spark, sf_dir, "part", v), src, dtype)
        rs = RasterSet.of({"price": of(None, "float64"), "half": of("p_retailprice / 2e0", "float64"), "size": of("p_size", "uint8")}, {"brands": read(spark, sf_dir, "part").select("p_brand")})
        out = rs.reproject_match(_shift(src), "bilinear", fill=False, coord_decimals=4)
        each = [rounded(out[n].df).select(F.lit(n).alias("variable"), "row", "col", F.col("v").cast("double").alias("v")) for n in ("price", "half", "size")]
        return each[0].unionByName(each[1]).unionByName(each[2])

    src = fixed_grid("part")
    parts = [(n, W.warp_sql(pixels_sql("part", v), src, _shift(src), "bilinear", None, dtype, coord_decimals=4, out_decimals=4)) for n, v, dtype in (("price", None, "float64"), ("half", "p_retailprice / 2e0", "float64"), ("size", "p_size", "uint8"))]
    register("dataset_two_types", query, " union all ".join(f"select '{n}' as variable, \"row\", col, cast(v as double) as v from ({q})" for n, q in parts))


add_dataset()


def add_mosaic() -> None:
    east = Affine(100, 0, 507000, 0, -100, 6600000)

    def grids(src: Grid) -> tuple[Grid, Grid]:
        return Grid("EPSG:32633", src.shape, east), Grid("EPSG:32633", (src.rows, 200), Affine(120, 0, 500000, 0, -100, 6600000))

    def query(spark, sf_dir):
        a = source_grid(spark, sf_dir, "orders")
        b, to = grids(a)
        px, other = pixels(spark, sf_dir, "orders"), pixels(spark, sf_dir, "orders", "o_totalprice / 2e0")
        parts = [RasterFrame(p, g).reproject_match(to, "nearest", fill=False, coord_decimals=4) for p, g in ((px, a), (other, b))]
        return rounded(mosaic(*parts).df)

    a = fixed_grid("orders")
    b, to = grids(a)
    one, two = (W.warp_sql(pixels_sql("orders", v), g, to, "nearest", coord_decimals=4, out_decimals=4) for v, g in ((None, a), ("o_totalprice / 2e0", b)))
    register("mosaic_two_zones", query, f'select "row", col, round(arg_min(v, p), 4) as v from (select *, 0 as p from ({one}) union all select *, 1 as p from ({two})) group by 1, 2')


add_mosaic()
