"""Which source window each destination tile needs.  Small plans are made on the driver, large ones by tasks; both are joined by tile."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridspark.operators.kernels import kernel_name, reach, scales
from gridspark.plans.grid import Affine, Grid, transform

AFFINE = "struct<a:double,b:double,c:double,d:double,e:double,f:double>"
PLAN = f"dst_r0 int, dst_r1 int, dst_c0 int, dst_c1 int, src_r0 int, src_r1 int, src_c0 int, src_c1 int, src_affine {AFFINE}, dst_affine {AFFINE}, h int, w int, has_data boolean"
_SIX = pa.struct([(k, pa.float64()) for k in "abcdef"])
_ARROW = [(f"{a}_{b}", pa.int32()) for a in ("dst", "src") for b in ("r0", "r1", "c0", "c1")] + [("src_affine", _SIX), ("dst_affine", _SIX), ("h", pa.int32()), ("w", pa.int32()), ("has_data", pa.bool_())]


def source_coords(src: Grid, dst: Grid, cols, rows) -> tuple[np.ndarray, np.ndarray]:
    """Fractional source (col, row) of corner-based destination coordinates."""
    x, y = transform(dst.crs, src.crs, *dst.affine.forward(np.asarray(cols, float), np.asarray(rows, float)))
    return src.affine.inverse().forward(x, y)


def _edge_and_lattice(r0: int, r1: int, c0: int, c1: int, points: int = 21, inner: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Corner-based points on a tile's rim and a lattice inside it."""
    rs, cs = np.linspace(r0, r1, points), np.linspace(c0, c1, points)
    gr, gc = (g.ravel() for g in np.meshgrid(np.linspace(r0, r1, inner + 2)[1:-1], np.linspace(c0, c1, inner + 2)[1:-1], indexing="ij"))
    return np.concatenate([cs, cs, np.full(points, c0), np.full(points, c1), gc]), np.concatenate([np.full(points, r0), np.full(points, r1), rs, rs, gr])


def plan_tile(src: Grid, dst: Grid, r0: int, r1: int, c0: int, c1: int, kernel: str, within: tuple[int, int, int, int] | None = None) -> dict:
    """within: the footprint of the source; a tile outside is not projected."""
    scale = scales(src.affine, dst.affine)
    rx, ry = reach(kernel, scale)
    box = (0, 0, 0, 0)
    if within and (r1 <= within[0] or r0 >= within[1] or c1 <= within[2] or c0 >= within[3]):
        fine = np.zeros(0, bool)
    else:
        sc, sr = source_coords(src, dst, *_edge_and_lattice(r0, r1, c0, c1))
        fine = np.isfinite(sc) & np.isfinite(sr)
    if fine.any():
        lo = lambda v, halo, n: int(min(max(math.floor(v.min() - halo) - 1, 0), n))
        hi = lambda v, halo, n: int(min(max(math.ceil(v.max() + halo) + 1, 0), n))
        box = (lo(sr[fine], ry, src.rows), hi(sr[fine], ry, src.rows), lo(sc[fine], rx, src.cols), hi(sc[fine], rx, src.cols))
    has = box[1] > box[0] and box[3] > box[2]
    if not has:
        box = (0, 0, 0, 0)
    return {
        "dst_r0": r0, "dst_r1": r1, "dst_c0": c0, "dst_c1": c1, "src_r0": box[0], "src_r1": box[1], "src_c0": box[2], "src_c1": box[3],
        "src_affine": src.affine.shifted(box[2], box[0]), "dst_affine": dst.affine.shifted(c0, r0), "h": r1 - r0, "w": c1 - c0, "has_data": has,
    }


def source_window(src: Grid, dst: Grid, kernel: str, points: int = 129, inner: int = 33) -> tuple[int, int, int, int] | None:
    """(first row, last row, first column, last column) of the source that dst can need; None if that can't be told or is
    everything.  A margin of the largest bend between neighbouring sample points covers what lies between them."""
    rx, ry = reach(kernel, scales(src.affine, dst.affine))
    cols, rows = np.meshgrid(np.linspace(0, dst.cols, points), np.linspace(0, dst.rows, inner))
    down, along = np.meshgrid(np.linspace(0, dst.rows, points), np.linspace(0, dst.cols, inner))
    out = []
    for c, r in ((cols, rows), (along, down)):
        x, y = source_coords(src, dst, c, r)
        if not (np.isfinite(x).all() and np.isfinite(y).all()):
            return None
        out.append((x, y))
    box = []
    for axis, halo, n in ((1, ry, src.rows), (0, rx, src.cols)):
        values = [o[axis] for o in out]
        bend = max(float(np.abs(np.diff(v, 2, axis=a)).max()) for v in values for a in (0, 1))
        lo, hi = min(float(v.min()) for v in values), max(float(v.max()) for v in values)
        margin = halo + bend + 2
        box += [max(0, math.floor(lo - margin)), min(n - 1, math.ceil(hi + margin))]
    return None if box == [0, src.rows - 1, 0, src.cols - 1] else tuple(box)  # type: ignore[return-value]


def footprint(src: Grid, dst: Grid, kernel: str) -> tuple[int, int, int, int] | None:
    """(first row, end row, first column, end column) of dst that the source's rim and inside cover, with a margin for what
    lies between the sample points; None if some of these can't be projected."""
    rx, ry = reach(kernel, scales(src.affine, dst.affine))
    c, r = np.meshgrid(np.linspace(-rx, src.cols + rx, 65), np.linspace(-ry, src.rows + ry, 65))
    x, y = source_coords(dst, src, c, r)
    if not (np.isfinite(x).all() and np.isfinite(y).all()):
        return None
    box = []
    for v, n in ((y, dst.rows), (x, dst.cols)):
        margin = max(float(np.abs(np.diff(v, 2, axis=a)).max()) for a in (0, 1)) + 2
        box += [min(n, max(0, math.floor(v.min() - margin))), min(n, max(0, math.ceil(v.max() + margin)))]
    return tuple(box)  # type: ignore[return-value]


def chunk_sizes(n: int, chunk: int) -> list[int]:
    """Full chunks and a remainder."""
    if chunk < 1:
        raise ValueError("tile size must be positive")
    return [chunk] * (n // chunk) + ([n % chunk] if n % chunk else [])


def batch_size(tile: tuple[int, int], itemsize: int, most: int = 256 << 20) -> int:
    """Bands that fit one task together."""
    return max(1, most // (tile[0] * tile[1] * itemsize))


def plan_reproject(src: Grid, dst: Grid, dst_chunks: tuple[int, int] | None = None, resampling: str = "bilinear") -> list[dict]:
    """One record per destination tile, row by row."""
    kernel = kernel_name(resampling)
    th, tw = dst_chunks or dst.shape
    out, r0, within = [], 0, footprint(src, dst, kernel)
    for h in chunk_sizes(dst.rows, th):
        c0 = 0
        for w in chunk_sizes(dst.cols, tw):
            out.append(plan_tile(src, dst, r0, r0 + h, c0, c0 + w, kernel, within))
            c0 += w
        r0 += h
    return out


def plan_frame(spark: SparkSession, plan: list[dict]) -> DataFrame:
    keys = ["dst_r0", "dst_r1", "dst_c0", "dst_c1", "src_r0", "src_r1", "src_c0", "src_c1", "src_affine", "dst_affine", "h", "w", "has_data"]
    return spark.createDataFrame([tuple(tuple(p[k]) if isinstance(p[k], Affine) else p[k] for k in keys) for p in plan], PLAN)


def plan_table(spark: SparkSession, src: Grid, dst: Grid, dst_chunks: tuple[int, int] | None = None, resampling: str = "bilinear", tiles_per_task: int = 2048) -> DataFrame:
    """The rows of plan_reproject, made by tasks: for grids of very many tiles."""
    kernel = kernel_name(resampling)
    th, tw = dst_chunks or dst.shape
    if min(th, tw) < 1:
        raise ValueError("tile size must be positive")
    down, across = -(-dst.rows // th), -(-dst.cols // tw)
    schema, within = pa.schema([(f, t) for f, t in _ARROW]), footprint(src, dst, kernel)

    def work(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo in range(0, len(ids), 512):
                rows = []
                for i in ids[lo : lo + 512]:
                    r, c = divmod(i, across)
                    p = plan_tile(src, dst, r * th, min(dst.rows, (r + 1) * th), c * tw, min(dst.cols, (c + 1) * tw), kernel, within)
                    rows.append({k: v._asdict() if isinstance(v, Affine) else v for k, v in p.items()})
                yield pa.RecordBatch.from_pylist(rows, schema)

    n = down * across
    return spark.range(0, n, 1, min(10_000, -(-n // tiles_per_task))).mapInArrow(work, PLAN)


def blocks_per_tile(plan: list[dict], tile: tuple[int, int]) -> int:
    """Most source tiles that one destination tile reads: its memory bound."""
    return max([((p["src_r1"] - 1) // tile[0] - p["src_r0"] // tile[0] + 1) * ((p["src_c1"] - 1) // tile[1] - p["src_c0"] // tile[1] + 1) for p in plan if p["has_data"]], default=0)
