"""Warps, coordinate grids and point transforms on pixel tables: plain Catalyst plans.

generate destination grid -> coordinate steps -> taps -> equi-join to source pixels -> weighted aggregate.
A pixel table has row INT, col INT, v and any key columns (band, time, variable); keys ride along in join and group.
The scalar texts and the value rules are shared with `warp_sql`, which writes the same warp for another SQL engine."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions.exprs import Steps, lit, run_frame, run_sql
from gridspark.functions.projections import between
from gridspark.operators.kernels import DTYPES, RADIUS, checked_dtype, fill_value, kernel_name, reach, scales, usable_nodata, weight_text
from gridspark.plans.grid import Grid
from gridspark.plans.planner import source_window


def affine_steps(t, col: str, row: str, x: str, y: str) -> Steps:
    a, b, c, d, e, f = map(lit, t)
    return [(x, f"{a} * {col} + {b} * {row} + {c}"), (y, f"{d} * {col} + {e} * {row} + {f}")]


def coordinate_steps(src: Grid, dst: Grid, decimals: int | None = None) -> Steps:
    """From destination (r, c) to fractional source (sc, sr)."""
    back = src.affine.inverse()
    steps, x, y = between(dst.crs, src.crs, "gx", "gy")
    steps = affine_steps(dst.affine, "(c + 0.5e0)", "(r + 0.5e0)", "gx", "gy") + steps + affine_steps(back, x, y, "sc", "sr")
    if decimals is not None:
        steps = steps[:-2] + [("sc0", steps[-2][1]), ("sr0", steps[-1][1]), ("sc", f"round(sc0, {decimals})"), ("sr", f"round(sr0, {decimals})")]
    return steps


def transform_points(points: DataFrame, src_crs: str, dst_crs: str, x: str = "x", y: str = "y", out: tuple[str, str] = ("x_out", "y_out")) -> DataFrame:
    """points with two more columns; any DataFrame, streaming ones too.  Nulls give nulls."""
    steps, u, v = between(src_crs, dst_crs, "_x", "_y")
    df = points.withColumns({"_x": F.col(x).cast("double"), "_y": F.col(y).cast("double")})
    return run_frame(steps, df).select(*points.columns, F.col(u).alias(out[0]), F.col(v).alias(out[1]))


def transform_points_sql(source: str, keep: str, src_crs: str, dst_crs: str, x: str, y: str, out: tuple[str, str], decimals: int) -> str:
    steps, u, v = between(src_crs, dst_crs, "_x", "_y")
    inner = run_sql(steps, f"(select *, cast({x} as double) as _x, cast({y} as double) as _y from {source})")
    return f"select {keep}, round({u}, {decimals}) as {out[0]}, round({v}, {decimals}) as {out[1]} from {inner}"


def grid_cells(spark: SparkSession, dst: Grid) -> DataFrame:
    i = F.col("id")
    return spark.range(dst.rows * dst.cols).select(F.expr(f"cast(id div {dst.cols} as int)").alias("r"), (i % dst.cols).cast("int").alias("c"))


def transform_grid(spark: SparkSession, src: Grid, dst: Grid, decimals: int | None = None) -> DataFrame:
    """(row, col, src_col, src_row) for every destination pixel centre."""
    cells = run_frame(coordinate_steps(src, dst, decimals), grid_cells(spark, dst))
    return cells.select(F.col("r").alias("row"), F.col("c").alias("col"), F.col("sc").alias("src_col"), F.col("sr").alias("src_row"))


# ---- taps and values ----------------------------------------------------------------------------


def _tap_rules(kernel: str, src: Grid, scale: tuple[float, float]) -> dict[str, str]:
    """Texts of first and last taps per axis (ta, tb for columns; ua, ub for rows), and of the pre-check."""
    rx, ry = reach(kernel, scale)
    rules = {"check": f"sc >= {lit(-rx)} and sc <= {lit(src.cols + rx)} and sr >= {lit(-ry)} and sr <= {lit(src.rows + ry)} and not isnan(sc) and not isnan(sr)"}
    if kernel == "nearest":
        rules["check"] = f"sc >= 0e0 and sc <= {lit(src.cols)} and sr >= 0e0 and sr <= {lit(src.rows)} and not isnan(sc) and not isnan(sr)"
    for s, n, a, b, h in (("sc", src.cols, "ta", "tb", max(scale[0] / 2, 0.5)), ("sr", src.rows, "ua", "ub", max(scale[1] / 2, 0.5))):
        if kernel == "nearest":
            lo = hi = f"least(cast(floor({s} + 1e-10) as bigint), {n - 1})"
        elif kernel == "average":
            lo, hi = f"cast(floor({s} - {lit(h)}) as bigint)", f"cast(ceil({s} + {lit(h)}) as bigint) - 1"
        else:
            k = int(RADIUS[kernel])
            lo, hi = f"cast(floor({s} - 0.5e0) as bigint) - {k - 1}", f"cast(floor({s} - 0.5e0) as bigint) + {k}"
        rules[a], rules[b] = f"greatest({lo}, 0)", f"least({hi}, {n - 1})"
        two = f"cast(floor({s} - 0.5e0) as bigint)"
        rules[f"{a}2"] = f"(case when {two} between 0 and {n - 1} then 1 else 0 end + case when {two} + 1 between 0 and {n - 1} then 1 else 0 end)"
    return rules


def _weights(kernel: str, scale: tuple[float, float]) -> Steps:
    if kernel == "nearest":
        return [("w", "1e0")]
    if kernel == "average":
        hx, hy = lit(max(scale[0] / 2, 0.5)), lit(max(scale[1] / 2, 0.5))
        return [("w", f"greatest(0e0, least(tc + 1e0, sc + {hx}) - greatest(tc + 0e0, sc - {hx})) * greatest(0e0, least(tr + 1e0, sr + {hy}) - greatest(tr + 0e0, sr - {hy}))")]
    steps = [("dx", "abs(sc - 0.5e0 - tc)"), ("dy", "abs(sr - 0.5e0 - tr)"), ("w", f"({weight_text(kernel, 'dx')}) * ({weight_text(kernel, 'dy')})")]
    return steps + ([("bw", f"{weight_text('bilinear', 'dx')} * {weight_text('bilinear', 'dy')}")] if kernel == "cubic" else [])


def _ok(nodata: float | None) -> str:
    return "v is not null and not isnan(v)" + (f" and v <> {lit(nodata)}" if nodata is not None and not math.isnan(nodata) else "")


def _sums(kernel: str, ok: str) -> Steps:
    out = [("n_ok", f"sum(case when {ok} then 1 else 0 end)"), ("sw", f"sum(case when {ok} then w else 0e0 end)"), ("swv", f"sum(case when {ok} then w * v else 0e0 end)")]
    if kernel == "cubic":
        near = "tc between floor(sc - 0.5e0) and floor(sc - 0.5e0) + 1 and tr between floor(sr - 0.5e0) and floor(sr - 0.5e0) + 1"
        out += [("n2_ok", f"sum(case when {ok} and {near} then 1 else 0 end)"), ("sb", f"sum(case when {ok} then bw else 0e0 end)"), ("sbv", f"sum(case when {ok} then bw * v else 0e0 end)")]
    return out


#: Values from the sums; n_in and n2_in are the taps in range of the kernel and of its inner 2 x 2.
_VALUE = {
    "bilinear": "case when n_in = 4 and n_ok < 4 then null when sw >= 1e-10 then swv / sw end",
    "cubic": "case when n_in = 16 and n_ok = 16 then swv when n2_in = 4 and n2_ok < 4 then null when sb >= 1e-10 then sbv / sb end",
    "lanczos": "case when abs(sw) >= 1e-10 then swv / sw end",
    "average": "case when sw >= 1e-15 then swv / sw end",
}


def typed_text(value: str, dtype: str, rounding: str, even: str = "rint({})") -> str:
    """The value as a type, still nullable; `truncate` drops what doesn't fit, `round` saturates."""
    _, sql, lo, hi = DTYPES[checked_dtype(dtype)]
    if lo is None:
        return f"cast({value} as {sql})"
    if rounding == "truncate":
        cut = f"(case when {value} < 0e0 then ceil({value}) else floor({value}) end)"
        return f"case when {value} > {lit(lo - 1)} and {value} < {lit(hi + 1)} and not isnan({value}) then cast({cut} as {sql}) end"
    return f"case when not isnan({value}) then cast(greatest({lit(lo)}, least({lit(hi)}, {even.format(value)})) as {sql}) end"


#: Key values (bands, times ..) up to which rows are made for each of them from a list on the driver.
MOST_KEYS = 10_000


def keyed_cells(cells: DataFrame, each: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Every cell once for each key."""
    names = [f"`{k}`" for k in keys]
    found = each.select(*names).limit(MOST_KEYS + 1).collect()
    if len(found) > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} values of {keys}; warp them in parts")
    if not found:
        return cells.where("false").select(*(F.lit(None).cast(each.schema[k].dataType).alias(k) for k in keys), *cells.columns)
    rows = F.array(*(F.struct(*(F.lit(r[k]).cast(each.schema[k].dataType).alias(k) for k in keys)) for r in found))
    return cells.select(F.explode(rows).alias("_key"), *cells.columns).select("_key.*", *cells.columns)


def warp_pixels(pixels: DataFrame, src: Grid, dst: Grid, resampling: str = "nearest", nodata: float | None = None, dtype: str = "float64", rounding: str = "round", keys: tuple[str, ...] = (), coord_decimals: int | None = None, coords: DataFrame | None = None, fill: bool = False) -> DataFrame:
    """(keys, row, col, v): the warped pixels that have a value; with `fill` all pixels, the rest at the fill value.

    coords (row, col, src_col, src_row) replaces the destination grid's own coordinates; average then takes 1 x 1 boxes."""
    spark, given = pixels.sparkSession, pixels
    kernel, nodata_in = kernel_name(resampling), usable_nodata(nodata, checked_dtype(dtype))
    if coords is None:
        at = run_frame(coordinate_steps(src, dst, coord_decimals), grid_cells(spark, dst))
        # one generated row: a barrier that keeps the optimizer from writing the whole projection into every predicate on sc and sr
        at = at.select("r", "c", F.inline(F.array(F.struct("sc", "sr"))))
        scale = scales(src.affine, dst.affine)
    else:
        at, scale = coords.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("src_col").alias("sc"), F.col("src_row").alias("sr")), (1.0, 1.0)
    rules = _tap_rules(kernel, src, scale)
    near = at.where(rules["check"])
    window = source_window(src, dst, kernel) if coords is None else None
    if window:  # reaches the scan of a table that has row and col
        pixels = pixels.where(F.col("row").between(*window[:2]) & F.col("col").between(*window[2:]))
    values = pixels.select(*keys, F.col("row").alias("tr"), F.col("col").alias("tc"), F.col("v").cast("double").alias("v"))
    if kernel == "nearest":
        taps = near.select("r", "c", F.expr(f"cast({rules['ua']} as int)").alias("tr"), F.expr(f"cast({rules['ta']} as int)").alias("tc"))
        bad = "v is null" + (f" or v = {lit(nodata_in)}" if nodata_in is not None and not math.isnan(nodata_in) else "")
        out = taps.join(values, ["tr", "tc"]).where(f"not ({bad})")
        out = out.select(*keys, "r", "c", "v")
    else:
        steps = {k: F.expr(rules[k]) for k in ("ta", "tb", "ua", "ub")}
        box = near.select("r", "c", "sc", "sr", *(e.alias(k) for k, e in steps.items()), *([F.expr(f"{rules['ta2']} * {rules['ua2']}").alias("n2_in")] if kernel == "cubic" else [])).where("ta <= tb and ua <= ub")
        box = box.withColumn("n_in", F.expr("(tb - ta + 1) * (ub - ua + 1)"))
        taps = box.withColumn("tr", F.explode(F.expr("sequence(cast(ua as int), cast(ub as int))"))).withColumn("tc", F.explode(F.expr("sequence(cast(ta as int), cast(tb as int))")))
        taps = run_frame(_weights(kernel, scale), taps)
        more = ["n2_in"] if kernel == "cubic" else []
        joined = taps.join(values, ["tr", "tc"])
        sums = joined.groupBy(*keys, "r", "c").agg(*(F.first(n).alias(n) for n in ["n_in", *more]), *(F.expr(e).alias(n) for n, e in _sums(kernel, _ok(nodata_in))))
        out = sums.select(*keys, "r", "c", F.expr(_VALUE[kernel]).alias("v"))
    out = out.withColumn("v", F.expr(typed_text("v", dtype, rounding))).where("v is not null")
    if fill:
        value = F.lit(fill_value(nodata, dtype)).cast(DTYPES[dtype][1])
        cells = grid_cells(spark, dst) if coords is None else at.select("r", "c")
        if keys:  # each key makes the grid's cells itself: no join
            each = given.select(*keys).distinct()
            if coords is None:
                each = each.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(dst.rows - 1)))).repartition(*keys, "r")
                cells = each.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(dst.cols - 1))))
            else:
                cells = keyed_cells(cells, each, keys)
        out = cells.join(out, [*keys, "r", "c"], "left").withColumn("v", F.coalesce("v", value))
    return out.select(*keys, F.col("r").alias("row"), F.col("c").alias("col"), "v")


def warp_sql(source: str, src: Grid, dst: Grid, resampling: str, nodata: float | None = None, dtype: str = "float64", rounding: str = "round", keys: tuple[str, ...] = (), coord_decimals: int | None = None, out_decimals: int | None = None, coords: str | None = None) -> str:
    """The same warp as one SELECT for DuckDB.  source: a query of keys, tr, tc, v; coords: a query of r, c, sc, sr."""
    kernel, nd = kernel_name(resampling), usable_nodata(nodata, dtype)
    scale = (1.0, 1.0) if coords else scales(src.affine, dst.affine)
    rules = _tap_rules(kernel, src, scale)
    cells = f"(select cast(floor(i / {lit(dst.cols)}) as int) as r, cast(i % {dst.cols} as int) as c from range({dst.rows * dst.cols}) t(i))"
    at = f"({coords})" if coords else run_sql(coordinate_steps(src, dst, coord_decimals), cells)
    k = "".join(f"{x}, " for x in keys)
    fin = lambda v: f"round({v}, {out_decimals}) + 0e0" if out_decimals is not None and DTYPES[dtype][2] is None else v
    cast = typed_text("v", dtype, rounding, "round_even({}, 0)")
    if kernel == "nearest":
        bad = "v is null" + (f" or v = {lit(nd)}" if nd is not None and not math.isnan(nd) else "")
        found = f"select {k}r, c, v from (select r, c, {rules['ua']} as tr, {rules['ta']} as tc from {at} where {rules['check']}) t join ({source}) s using (tr, tc) where not ({bad})"
    else:
        more = f", {rules['ta2']} * {rules['ua2']} as n2_in" if kernel == "cubic" else ""
        box = f"(select r, c, sc, sr, {rules['ta']} as ta, {rules['tb']} as tb, {rules['ua']} as ua, {rules['ub']} as ub{more} from {at} where {rules['check']})"
        rows = f"(select *, (tb - ta + 1) * (ub - ua + 1) as n_in, unnest(range(ua, ub + 1)) as tr from {box} where ta <= tb and ua <= ub)"
        taps = run_sql(_weights(kernel, scale), f"(select *, unnest(range(ta, tb + 1)) as tc from {rows})")
        firsts = ", ".join(f"min({n}) as {n}" for n in (["n_in", "n2_in"] if kernel == "cubic" else ["n_in"]))
        sums = ", ".join(f"{e} as {n}" for n, e in _sums(kernel, _ok(nd)))
        found = f"select {k}r, c, {_VALUE[kernel]} as v from (select {k}r, c, {firsts}, {sums} from {taps} t join ({source}) s using (tr, tc) group by {k}r, c)"
    return f'select {k}r as "row", c as col, {fin("v")} as v from (select {k}r, c, {cast} as v from ({found})) where v is not null'


def reproject_with_grid(pixels: DataFrame, src: Grid, coords: DataFrame, dst: Grid, resampling: str = "nearest", **options) -> DataFrame:
    """Sample at given coordinates (row, col, src_col, src_row); pixels with null or NaN coordinates stay empty."""
    return warp_pixels(pixels, src, dst, resampling, coords=coords, **options)
