"""Affine transforms and grids: driver-side values of a few numbers."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np

from gridspark.functions.exprs import run_numpy
from gridspark.functions.projections import between


class Affine(NamedTuple):
    """x = a * col + b * row + c, y = d * col + e * row + f."""

    a: float
    b: float
    c: float
    d: float
    e: float
    f: float

    @classmethod
    def from_gdal(cls, g) -> Affine:
        c, a, b, f, d, e = g
        return cls(a, b, c, d, e, f)

    def to_gdal(self) -> tuple:
        return (self.c, self.a, self.b, self.f, self.d, self.e)

    def to_tuple(self) -> tuple:
        return tuple(self)

    def forward(self, col, row):
        return self.a * col + self.b * row + self.c, self.d * col + self.e * row + self.f

    def inverse(self) -> Affine:
        det, scale = self.a * self.e - self.b * self.d, max(abs(v) for v in (self.a, self.b, self.d, self.e))
        if not scale or abs(det) < 1e-14 * scale * scale:
            raise ValueError("Singular affine transform")
        a, b, d, e = self.e / det, -self.b / det, -self.d / det, self.a / det
        return Affine(a, b, -(a * self.c + b * self.f), d, e, -(d * self.c + e * self.f))

    def shifted(self, col0: int, row0: int) -> Affine:
        """The same grid counted from (col0, row0)."""
        x, y = self.forward(col0, row0)
        return self._replace(c=x, f=y)


@dataclass(frozen=True)
class Grid:
    """A regular grid: CRS string, (rows, cols), affine of corner-based pixel coordinates.  Hashable, equal by value."""

    crs: str
    shape: tuple[int, int]
    affine: Affine

    def __post_init__(self):
        object.__setattr__(self, "shape", (int(self.shape[0]), int(self.shape[1])))
        object.__setattr__(self, "affine", Affine(*map(float, self.affine)))
        if min(self.shape) < 1:
            raise ValueError("a grid needs at least one row and one column")

    @property
    def rows(self) -> int:
        return self.shape[0]

    @property
    def cols(self) -> int:
        return self.shape[1]

    @classmethod
    def from_bbox(cls, bbox, crs: str, shape=None, resolution=None) -> Grid:
        """bbox is (left, bottom, right, top); a shape wins over a resolution (number or (x, y))."""
        left, bottom, right, top = bbox
        if shape is not None:
            rows, cols = shape
            rx, ry = (right - left) / cols, (top - bottom) / rows
        elif resolution is not None:
            rx, ry = resolution if isinstance(resolution, tuple | list) else (resolution, resolution)
            cols, rows = max(1, round((right - left) / rx)), max(1, round((top - bottom) / ry))
        else:
            raise ValueError("either shape or resolution is needed")
        return cls(crs, (rows, cols), Affine(rx, 0.0, left, 0.0, -ry, top))

    @classmethod
    def from_coords(cls, xs, ys, crs: str) -> Grid:
        """From pixel-centre coordinates; the first two of each axis give the resolution."""
        if len(xs) < 2 or len(ys) < 2:
            raise ValueError("two coordinates at least are needed on each axis")
        rx, ry = float(xs[1]) - float(xs[0]), float(ys[1]) - float(ys[0])
        return cls(crs, (len(ys), len(xs)), Affine(rx, 0.0, float(xs[0]) - rx / 2, 0.0, ry, float(ys[0]) - ry / 2))

    @classmethod
    def of(cls, other) -> Grid:
        """A grid as it is; the grid of anything that has one (`grid`); or of an object with crs, shape and affine (or transform)."""
        if isinstance(other, Grid):
            return other
        if isinstance(getattr(other, "grid", None), Grid):
            return other.grid
        if all(hasattr(other, k) for k in ("crs", "shape")) and (hasattr(other, "affine") or hasattr(other, "transform")):
            return cls.from_odc(other)
        raise TypeError(f"a grid is needed, or an object with crs, shape and affine; not {type(other).__name__}")

    @classmethod
    def from_odc(cls, box) -> Grid:
        """From any object with crs, shape (y, x) and affine a..f."""
        t = box.affine if hasattr(box, "affine") else box.transform
        return cls(str(box.crs), (box.shape.y, box.shape.x) if hasattr(box.shape, "y") else tuple(box.shape), Affine(*(getattr(t, k) for k in "abcdef")))

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        xs, ys = zip(*(self.affine.forward(c, r) for c in (0, self.cols) for r in (0, self.rows)), strict=True)
        return min(xs), min(ys), max(xs), max(ys)

    @property
    def resolution(self) -> tuple[float, float]:
        return abs(self.affine.a), abs(self.affine.e)

    def coords(self) -> tuple[np.ndarray, np.ndarray]:
        """Pixel-centre coordinates of the first row and column."""
        i, j = np.arange(self.cols) + 0.5, np.arange(self.rows) + 0.5
        t = self.affine
        return t.c + t.a * i + 0.5 * t.b, t.f + t.e * j + 0.5 * t.d

    def window(self, r0: int, r1: int, c0: int, c1: int) -> Grid:
        return Grid(self.crs, (r1 - r0, c1 - c0), self.affine.shifted(c0, r0))


def transform(src: str, dst: str, x, y) -> tuple[np.ndarray, np.ndarray]:
    steps, u, v = between(src, dst, "x", "y")
    out = run_numpy(steps, {"x": np.asarray(x, float), "y": np.asarray(y, float)})
    return np.broadcast_to(out[u], np.shape(x)), np.broadcast_to(out[v], np.shape(x))


def boundary(left: float, bottom: float, right: float, top: float, points: int = 21) -> tuple[np.ndarray, np.ndarray]:
    s, t = np.linspace(left, right, points), np.linspace(bottom, top, points)
    return np.concatenate([s, s, np.full(points, left), np.full(points, right)]), np.concatenate([np.full(points, bottom), np.full(points, top), t, t])


def projected_grid(src: Grid, crs: str, resolution=None, shape=None) -> Grid:
    """The grid of another CRS that covers src: its bounds' edges (21 points each) are projected; as many pixels as src
    unless a shape or a resolution is given."""
    x, y = transform(src.crs, crs, *boundary(*src.bounds))
    fine = np.isfinite(x) & np.isfinite(y)
    if not fine.any():
        raise ValueError(f"no point of the grid can be projected to {crs}")
    box = (float(x[fine].min()), float(y[fine].min()), float(x[fine].max()), float(y[fine].max()))
    if shape is None and resolution is None:
        n, aspect = src.rows * src.cols, (box[2] - box[0]) / max(box[3] - box[1], 1e-300)
        cols = max(1, round(math.sqrt(n * aspect)))
        shape = (max(1, round(n / cols)), cols)
    return Grid.from_bbox(box, crs, shape, resolution)
