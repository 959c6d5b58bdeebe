"""The tile path: a plan joins destination tiles to the source tiles they read, and an Arrow kernel warps each.

One destination tile (and a batch of bands) is one group; its source window is bounded by the plan, and tiles whose window
would pass `max_bytes` are refused with advice, since a group has to fit its task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.operators.kernels import DTYPES, Taps, checked_dtype, fill_value, kernel_name, scales, typed, usable_nodata
from gridspark.operators.warp import keyed_cells
from gridspark.plans.grid import Grid
from gridspark.plans.planner import plan_frame, plan_reproject, plan_table, source_coords
from gridspark.sources.adapters import schema_of


#: Destination tiles up to which the driver makes the plan; beyond it tasks do.
DRIVER_PLAN = 4096
#: Rows (pairs of a destination tile and a source tile) up to which a plan is broadcast.
BROADCAST_ROWS = 200_000


def scanline_coords(src: Grid, dst: Grid, r0: int, c0: int, h: int, w: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates by linear pieces along each row: a piece is halved until its middle is within `threshold` pixels.

    All rows' pieces of one depth are measured at once."""
    cols, rows = np.empty((h, w)), np.empty((h, w))
    line, a, b = np.arange(h), np.zeros(h, np.int64), np.full(h, w - 1)
    for depth in range(21):
        m = (a + b) // 2
        x, y = source_coords(src, dst, c0 + np.stack([a, m, b]) + 0.5, r0 + np.broadcast_to(line, (3, len(line))) + 0.5)
        t = (m - a) / np.maximum(b - a, 1)
        with np.errstate(invalid="ignore"):
            error = np.maximum(np.abs(x[0] + t * (x[2] - x[0]) - x[1]), np.abs(y[0] + t * (y[2] - y[0]) - y[1]))
            split = (error > threshold) & (b - a > 1) & (depth < 20)
        done = np.flatnonzero(~split)
        size = b[done] - a[done] + 1
        whole = depth == 0  # pieces are rows
        if not whole:
            piece = np.repeat(np.arange(len(done)), size)
            step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            part = step / np.maximum(size[piece] - 1, 1)
        for out, v in ((cols, x), (rows, y)):
            p, q = v[0][done], v[2][done]
            if whole:
                out[done] = p[:, None] + np.linspace(0, 1, w) * (q - p)[:, None]
            else:
                out[line[done][piece], a[done][piece] + step] = p[piece] + part * (q - p)[piece]
            for i, at in enumerate((a, m, b)):
                out[line[done], at[done]] = v[i][done]
        at = np.flatnonzero(split)
        if not len(at):
            break
        line, a, b = np.concatenate([line[at], line[at]]), np.concatenate([a[at], m[at]]), np.concatenate([m[at], b[at]])
    return cols, rows


def reproject_tiles(tiles: DataFrame, src: Grid, dst: Grid, resampling: str = "bilinear", nodata: float | None = None, dtype: str = "float64", rounding: str = "round", keys: tuple[str, ...] = (), tile: tuple[int, int] = (256, 256), dst_chunks: tuple[int, int] | None = (256, 256), error_threshold: float | None = None, coord_decimals: int | None = None, max_bytes: int = 256 << 20, driver_plan: int = DRIVER_PLAN) -> DataFrame:
    """Tile table of dst.  Tiles without source data are filled without touching the source.

    Only source tiles in the plan's range of tile rows and columns are read (a store by tile_row skips the others' files).  As many
    bands (values of `keys`) as `max_bytes` allows share a group, so coordinates are computed once for all of them."""
    kernel, kind = kernel_name(resampling), DTYPES[checked_dtype(dtype)][0]
    nd, fill = usable_nodata(nodata, dtype), fill_value(nodata, dtype)
    scale = scales(src.affine, dst.affine)
    th, tw = dst_chunks or dst.shape
    few = -(-dst.rows // th) * -(-dst.cols // tw) <= driver_plan
    if few:
        rows = plan_reproject(src, dst, dst_chunks, kernel)
        held = [p for p in rows if p["has_data"]]
        big = max([(p["src_r1"] - p["src_r0"]) * (p["src_c1"] - p["src_c0"]) * 8 for p in held], default=0)
        box = [f(p[k] for p in held) for f, k in ((min, "src_r0"), (max, "src_r1"), (min, "src_c0"), (max, "src_c1"))] if held else [0, 0, 0, 0]
    else:
        plan = plan_table(tiles.sparkSession, src, dst, dst_chunks, kernel)
        big, *box = (x or 0 for x in plan.where("has_data").agg(F.max(F.expr("8L * (src_r1 - src_r0) * (src_c1 - src_c0)")), F.min("src_r0"), F.max("src_r1"), F.min("src_c0"), F.max("src_c1")).first())
    if big > max_bytes:
        raise ValueError(f"a destination tile reads {big >> 20} MiB of source; take smaller dst_chunks than {(th, tw)}")
    spark, given = tiles.sparkSession, tiles
    tiles = tiles.where(F.col("tile_row").between(box[0] // tile[0], max(box[0], box[1] - 1) // tile[0]) & F.col("tile_col").between(box[2] // tile[1], max(box[2], box[3] - 1) // tile[1]))
    if few:
        plan = plan_frame(spark, rows)
    place = f"dst_r0 div {th} as d_row", f"dst_c0 div {tw} as d_col", "dst_r0 as d_r0", "dst_c0 as d_c0", "h as d_h", "w as d_w"
    window = ["d_row", "d_col", "d_r0", "d_c0", "d_h", "d_w", "s_r0", "s_r1", "s_c0", "s_c1"]
    held_by = plan.where("has_data").selectExpr(*place, "src_r0 as s_r0", "src_r1 as s_r1", "src_c0 as s_c0", "src_c1 as s_c1")
    blocks = lambda lo, hi, n: F.explode(F.expr(f"transform(sequence({lo} div {n}, ({hi} - 1) div {n}), x -> cast(x as int))"))
    wanted = held_by.withColumn("tile_row", blocks("s_r0", "s_r1", tile[0])).withColumn("tile_col", blocks("s_c0", "s_c1", tile[1]))
    if few and sum(((p["src_r1"] - 1) // tile[0] - p["src_r0"] // tile[0] + 1) * ((p["src_c1"] - 1) // tile[1] - p["src_c0"] // tile[1] + 1) for p in held) <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)  # its rows are counted; tiles then shuffle once, to their destination
    schema = schema_of(tiles, keys) + "tile_row int, tile_col int, r0 int, c0 int, h int, w int, data binary"

    def warp(t: pa.Table) -> pa.Table:
        d_row, d_col, r0, c0, h, w, s0, s1, q0, q1 = (t.column(c)[0].as_py() for c in window)
        if error_threshold is None:
            rr, cc = np.meshgrid(np.arange(r0, r0 + h) + 0.5, np.arange(c0, c0 + w) + 0.5, indexing="ij")
            x, y = source_coords(src, dst, cc, rr)
        else:
            x, y = scanline_coords(src, dst, r0, c0, h, w, error_threshold)
        if coord_decimals is not None:
            x, y = np.round(x, coord_decimals), np.round(y, coord_decimals)
        bands: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(*(t.column(k).to_pylist() for k in keys), strict=True) if keys else [()] * t.num_rows):
            bands.setdefault(key, []).append(i)
        place, raw = [t.column(c).to_pylist() for c in ("r0", "c0", "h", "w")], t.column("data")
        first, out = [], []
        taps = Taps(x, y, kernel, scale, (s0, q0), (s1 - s0, q1 - q0), src.shape)
        for of in bands.values():
            values = np.full((s1 - s0, q1 - q0), np.nan)  # what the store doesn't have stays NaN
            for i in of:
                a, b, bh, bw = (p[i] for p in place)
                block = np.frombuffer(raw[i].as_buffer(), kind).reshape(bh, bw)
                i0, i1, j0, j1 = max(a, s0), min(a + bh, s1), max(b, q0), min(b + bw, q1)
                if i1 > i0 and j1 > j0:
                    values[i0 - s0 : i1 - s0, j0 - q0 : j1 - q0] = block[i0 - a : i1 - a, j0 - b : j1 - b]
            v, ok = taps.values(values, nd)
            first.append(of[0])
            out.append(typed(v, ok, dtype, fill, rounding).tobytes())
        same = {c: pa.array([v] * len(out), pa.int32()) for c, v in zip(("tile_row", "tile_col", "r0", "c0", "h", "w"), (d_row, d_col, r0, c0, h, w), strict=True)}
        return pa.table({k: t.column(k).take(pa.array(first)) for k in keys} | same | {"data": pa.array(out, pa.binary())})

    each = given.select(*(f"`{k}`" for k in keys)).distinct() if keys else None
    joined, by = tiles.join(wanted, ["tile_row", "tile_col"]), ["d_row", "d_col"]
    if keys:
        together = max(1, max_bytes // max(1, big + 8 * th * tw * 4))
        if (parts := -(-each.count() // together)) > 1:
            joined = joined.withColumn("_part", F.pmod(F.xxhash64(*(f"`{k}`" for k in keys)), F.lit(parts)))
            by = ["_part", *by]
    done = joined.groupBy(*by).applyInArrow(warp, schema)
    one = np.array([fill]).astype(kind).tobytes().hex()
    cast = [f"cast(dst_r0 div {th} as int) as tile_row", f"cast(dst_c0 div {tw} as int) as tile_col", "dst_r0 as r0", "dst_c0 as c0", "h", "w", f"unhex(repeat('{one}', h * w)) as data"]
    blank = plan.where("not has_data").selectExpr(*cast)
    return done.unionByName(keyed_cells(blank, each, keys) if keys else blank)
