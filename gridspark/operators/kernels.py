"""The five resampling kernels, and what they do at edges, with nodata and with integer types.

Coordinates are corner-based fractional source pixels; a tap at pixel i is |x - 0.5 - i| away.
  nearest   the pixel that holds the coordinate; NaN is a value, the sentinel isn't
  bilinear  2 x 2; a bad tap among four spoils the pixel, at the rim what is in range and good is renormalised
  cubic     4 x 4 Keys (a = -0.5), not renormalised; where a tap is bad or out of range, bilinear instead
  lanczos   6 x 6, what is in range and good is renormalised (so up to 2.5 pixels outside are extrapolated)
  average   area overlap with the destination pixel's box, what is in range and good is renormalised
"""

from __future__ import annotations

import numpy as np

from gridspark.functions.exprs import lit
from gridspark.plans.grid import Affine

KERNELS = ("nearest", "bilinear", "cubic", "lanczos", "average")
RADIUS = {"nearest": 0.5, "bilinear": 1.0, "cubic": 2.0, "lanczos": 3.0, "average": 1.0}
#: name -> (numpy type, Spark type, least, greatest); Spark has no unsigned types.
DTYPES = {
    "float64": ("<f8", "double", None, None), "float32": ("<f4", "float", None, None), "int8": ("i1", "tinyint", -128, 127),
    "int16": ("<i2", "smallint", -32768, 32767), "uint8": ("u1", "smallint", 0, 255), "uint16": ("<u2", "int", 0, 65535),
}


def kernel_name(name: str) -> str:
    low = str(name).lower()
    if low not in KERNELS:
        raise ValueError(f"Unknown resampling method: {name}")
    return low


def checked_dtype(dtype: str) -> str:
    if dtype not in DTYPES:
        raise ValueError(f"Unsupported dtype: {dtype}")
    return dtype


def scales(src: Affine, dst: Affine) -> tuple[float, float]:
    """Destination pixel sizes in source pixels, by the transforms' numbers alone."""
    return float(np.hypot(dst.a, dst.d) / max(np.hypot(src.a, src.d), 1e-15)), float(np.hypot(dst.b, dst.e) / max(np.hypot(src.b, src.e), 1e-15))


def reach(kernel: str, scale: tuple[float, float]) -> tuple[float, float]:
    """How far outside the source a coordinate may be, by axis."""
    return tuple(max(RADIUS[kernel], s / 2) if kernel == "average" else RADIUS[kernel] for s in scale)  # type: ignore[return-value]


def usable_nodata(nodata: float | None, dtype: str) -> float | None:
    """A sentinel that the type can't hold is none."""
    _, _, lo, hi = DTYPES[dtype]
    if nodata is None or lo is None:
        return nodata
    return float(int(nodata)) if nodata == nodata and lo - 1 < nodata < hi + 1 else None


def fill_value(nodata: float | None, dtype: str) -> float:
    use = usable_nodata(nodata, dtype)
    return use if use is not None else float("nan") if DTYPES[dtype][2] is None else 0.0


# ---- texts for SQL ------------------------------------------------------------------------------


def weight_text(kernel: str, t: str) -> str:
    """One axis' weight at distance t (a column of doubles >= 0)."""
    if kernel == "bilinear":
        return f"greatest(0e0, 1e0 - {t})"
    if kernel == "cubic":
        near, far = f"(1.5e0 * {t} - 2.5e0) * {t} * {t} + 1e0", f"((-0.5e0 * {t} + 2.5e0) * {t} - 4e0) * {t} + 2e0"
        return f"case when {t} < 1e0 then {near} when {t} < 2e0 then {far} else 0e0 end"
    pi = lit(np.pi)
    return f"case when {t} < 1e-8 then 1e0 when {t} < 3e0 then 3e0 * sin({pi} * {t}) * sin({pi} * {t} / 3e0) / ({pi} * {pi} * {t} * {t}) else 0e0 end"


# ---- numpy --------------------------------------------------------------------------------------


def _weight(kernel: str, t: np.ndarray) -> np.ndarray:
    t = np.abs(t)
    if kernel == "bilinear":
        return np.maximum(0, 1 - t)
    if kernel == "cubic":
        return np.where(t < 1, (1.5 * t - 2.5) * t * t + 1, np.where(t < 2, ((-0.5 * t + 2.5) * t - 4) * t + 2, 0.0))
    return np.where(t < 3, np.sinc(t) * np.sinc(t / 3), 0.0)


class Taps:
    """Where and with what weights pixels at fractional coordinates read the source: computed once for any number of bands.

    Weights are products of one factor an axis.  Where all taps lie in the window and none is bad, values are plain sums; only
    the other pixels count their taps one by one."""

    def __init__(self, cols: np.ndarray, rows: np.ndarray, kernel: str, scale: tuple[float, float], origin: tuple[int, int], window: tuple[int, int], full: tuple[int, int]):
        self.kernel, self.origin, self.window, self.full, self.shape = kernel, origin, window, full, np.shape(cols)
        (r0, c0), (h, w) = origin, window
        x, y = np.asarray(cols, float).ravel(), np.asarray(rows, float).ravel()
        rx, ry = reach(kernel, scale) if kernel != "nearest" else (0.0, 0.0)
        with np.errstate(invalid="ignore"):
            inside = (x >= -rx) & (x <= full[1] + rx) & (y >= -ry) & (y <= full[0] + ry)
        self.size, self.at = len(x), np.flatnonzero(inside)
        x, y = x[self.at], y[self.at]
        self.half = (max(scale[0] / 2, 0.5), max(scale[1] / 2, 0.5))
        if kernel == "nearest":
            self.i, self.j = (np.minimum(np.floor(v + 1e-10).astype(np.int64), n - 1) for v, n in ((y, full[0]), (x, full[1])))
            self.ni = self.nj = 1
        elif kernel == "average":
            self.i, self.j = np.floor(y - self.half[1]).astype(np.int64), np.floor(x - self.half[0]).astype(np.int64)
            self.ni, self.nj = int(np.ceil(2 * self.half[1])) + 1, int(np.ceil(2 * self.half[0])) + 1
        else:
            k = int(RADIUS[kernel])
            self.i, self.j = np.floor(y - 0.5).astype(np.int64) - k + 1, np.floor(x - 0.5).astype(np.int64) - k + 1
            self.ni = self.nj = 2 * k
        self.wy, self.wx = self._factors(y, self.i, self.ni, self.half[1]), self._factors(x, self.j, self.nj, self.half[0])
        self.x, self.y = x, y
        whole = (self.i >= max(0, r0)) & (self.i + self.ni <= min(full[0], r0 + h)) & (self.j >= max(0, c0)) & (self.j + self.nj <= min(full[1], c0 + w))
        self.inner, self.rim = np.flatnonzero(whole), np.flatnonzero(~whole)

    def _factors(self, t: np.ndarray, first: np.ndarray, n: int, half: float) -> list[np.ndarray]:
        if self.kernel == "nearest":
            return [np.broadcast_to(1.0, len(t))]
        if self.kernel == "average":
            return [np.clip(np.minimum(first + k + 1, t + half) - np.maximum(first + k, t - half), 0, None) for k in range(n)]
        return [_weight(self.kernel, t - 0.5 - (first + k)) for k in range(n)]

    def values(self, src: np.ndarray, nodata: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(values, valid) of one band, of which src holds the window."""
        flat = np.asarray(src, np.float64).ravel()
        bad = np.isnan(flat) if self.kernel != "nearest" else np.zeros(len(flat), bool)
        if nodata is not None and nodata == nodata:
            bad |= flat == nodata
        out, ok = np.zeros(self.size), np.zeros(self.size, bool)
        spoiled = bad.any()
        if not spoiled and len(self.inner):
            out[self.at[self.inner]], ok[self.at[self.inner]] = self._plain(flat, self.inner), True
        some = np.arange(len(self.at)) if spoiled else self.rim
        if len(some):
            v, fine = self._counted(flat, bad, some)
            out[self.at[some]], ok[self.at[some]] = np.where(fine, v, 0), fine
        return out.reshape(self.shape), ok.reshape(self.shape)

    def _plain(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        (r0, c0), w = self.origin, self.window[1]
        base = (self.i[at] - r0) * w + (self.j[at] - c0)
        if self.kernel == "nearest":
            return flat[base]
        wx, total = [f[at] for f in self.wx], np.zeros(len(at))
        for di, fy in enumerate(self.wy):
            line = np.zeros(len(at))
            for dj, fx in enumerate(wx):
                line += fx * flat[base + (di * w + dj)]
            total += fy[at] * line
        return total if self.kernel == "cubic" else total / (sum(f[at] for f in self.wy) * sum(wx))

    def _counted(self, flat: np.ndarray, bad: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (r0, c0), (h, w), full, kernel = self.origin, self.window, self.full, self.kernel
        x, y, first_i, first_j = self.x[at], self.y[at], self.i[at], self.j[at]
        sums = np.zeros((6, len(at)))  # weights, weighted values, taps in range, good taps; bilinear weights and values
        two = np.zeros((2, len(at)))
        for di in range(self.ni):
            i = first_i + di
            here_i, held_i, by = (i >= 0) & (i < full[0]), (i >= r0) & (i < r0 + h), np.maximum(0, 1 - np.abs(y - 0.5 - i))
            for dj in range(self.nj):
                j = first_j + dj
                in_range, held = here_i & (j >= 0) & (j < full[1]), held_i & (j >= c0) & (j < c0 + w)
                place = np.where(held, (i - r0) * w + (j - c0), 0)
                good = held & in_range & ~bad[place]
                v, weight = np.where(good, flat[place], 0), np.where(good, self.wy[di][at] * self.wx[dj][at], 0)
                sums[:4] += weight, weight * v, in_range, good
                if kernel == "cubic" and di in (1, 2) and dj in (1, 2):
                    b = np.where(good, by * np.maximum(0, 1 - np.abs(x - 0.5 - j)), 0)
                    sums[4:] += b, b * v
                    two += in_range, good
        with np.errstate(invalid="ignore", divide="ignore"):
            if kernel == "nearest":
                return sums[1], sums[3] > 0
            if kernel == "bilinear":
                return sums[1] / sums[0], (sums[0] >= 1e-10) & ~((sums[2] == 4) & (sums[3] < 4))
            if kernel == "cubic":
                whole = (sums[2] == 16) & (sums[3] == 16)
                return np.where(whole, sums[1], sums[5] / sums[4]), whole | ((sums[4] >= 1e-10) & ~((two[0] == 4) & (two[1] < 4)))
            return sums[1] / sums[0], np.abs(sums[0]) >= (1e-15 if kernel == "average" else 1e-10)


def sample(src: np.ndarray, cols: np.ndarray, rows: np.ndarray, kernel: str, nodata: float | None = None, scale: tuple[float, float] = (1.0, 1.0), origin: tuple[int, int] = (0, 0), shape: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(values, valid) at fractional coordinates of the whole source, of which `src` holds the part from `origin` (row, col)."""
    return Taps(cols, rows, kernel, scale, origin, src.shape, shape or src.shape).values(src, nodata)


def typed(values: np.ndarray, valid: np.ndarray, dtype: str, fill: float, rounding: str = "round") -> np.ndarray:
    """Values as the type: `round` to even and saturate, or `truncate` toward zero with what doesn't fit filled."""
    kind, _, lo, hi = DTYPES[dtype]
    if lo is None:
        return np.where(valid, values, fill).astype(kind)
    if rounding == "truncate":
        cut = np.trunc(values)
        fits = valid & np.isfinite(values) & (cut >= lo) & (cut <= hi)
    else:
        cut = np.clip(np.rint(values), lo, hi)
        fits = valid & ~np.isnan(values)
    return np.where(fits, np.where(fits, cut, 0), fill).astype(kind)
