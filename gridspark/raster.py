"""RasterFrame: a tile or pixel table with its grid, element type and nodata; warps keep keys, name and metadata.
RasterSet: variables of several types that are warped together, one shuffle for each type."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.operators.kernels import checked_dtype, fill_value
from gridspark.operators.tiles import reproject_tiles
from gridspark.operators.warp import warp_pixels
from gridspark.plans.grid import Grid, projected_grid
from gridspark.sources.adapters import TILE, pixels_to_tiles, tiles_to_pixels


def spatial_ref(grid: Grid) -> dict:
    """What a file's spatial_ref holds: the code or text of the CRS and the transform in GDAL's order."""
    named = {"epsg": int(grid.crs[5:])} if grid.crs.upper().startswith("EPSG:") else {"proj4": grid.crs}
    return {**named, "GeoTransform": " ".join(repr(x) for x in grid.affine.to_gdal())}


@dataclass(frozen=True)
class RasterFrame:
    """layout is `pixels` (keys, row, col, v) or `tiles`; keys are the columns of all other dimensions (band, time, variable)."""

    df: DataFrame
    grid: Grid
    dtype: str = "float64"
    nodata: float | None = None
    keys: tuple[str, ...] = ()
    layout: str = "pixels"
    tile: tuple[int, int] = TILE
    attrs: dict = field(default_factory=dict)

    def __post_init__(self):
        checked_dtype(self.dtype)
        if self.layout not in ("pixels", "tiles"):
            raise ValueError(f"Unknown layout: {self.layout}")

    @property
    def crs(self) -> str:
        return self.grid.crs

    @property
    def geobox(self) -> Grid:
        return self.grid

    def to_tiles(self) -> RasterFrame:
        if self.layout == "tiles":
            return self
        return replace(self, df=pixels_to_tiles(self.df, self.grid.shape, self.dtype, self.keys, self.tile, fill_value(self.nodata, self.dtype)), layout="tiles")

    def to_pixels(self) -> RasterFrame:
        return self if self.layout == "pixels" else replace(self, df=tiles_to_pixels(self.df, self.dtype, self.keys), layout="pixels")

    def reproject_match(self, other, resampling: str = "bilinear", path: str = "auto", dst_chunks: tuple[int, int] | None = TILE, rounding: str = "round", coord_decimals: int | None = None, fill: bool = True, nodata: float | None = None, error_threshold: float | None = None, max_task_bytes: int = 256 << 20) -> RasterFrame:
        """Onto another raster's grid (anything that Grid.of takes).  path: `tile` (dense rasters), `sql` (pixel tables), or `auto`
        by layout, where an error_threshold asks for tiles.

        nodata replaces the raster's own.  error_threshold: coordinates by linear pieces along rows, as near as so many source
        pixels; exact without.  max_task_bytes: source bytes that one task may hold, bands together."""
        dst = Grid.of(other)
        attrs = {k: v for k, v in self.attrs.items() if k not in ("crs", "transform", "spatial_ref", "spatial_ref_attrs")} | {"spatial_ref": dst.crs, "spatial_ref_attrs": spatial_ref(dst)}
        if nodata is not None:
            self = replace(self, nodata=nodata)
        if path == "sql" and error_threshold is not None:
            raise ValueError("coordinates are exact on the sql path; take path='tile' for an error_threshold")
        if path == "tile" or path == "auto" and (error_threshold is not None or self.layout == "tiles"):
            src = self.to_tiles()
            out = reproject_tiles(src.df, self.grid, dst, resampling, self.nodata, self.dtype, rounding, self.keys, self.tile, dst_chunks, error_threshold, coord_decimals, max_task_bytes)
            return replace(self, df=out, grid=dst, layout="tiles", tile=dst_chunks or dst.shape, attrs=attrs)
        out = warp_pixels(self.to_pixels().df, self.grid, dst, resampling, self.nodata, self.dtype, rounding, self.keys, coord_decimals, fill=fill)
        return replace(self, df=out, grid=dst, layout="pixels", attrs=attrs)

    def reproject(self, crs: str, resolution=None, shape=None, resampling: str = "bilinear", **options) -> RasterFrame:
        """Onto the grid of another CRS that covers this one."""
        return self.reproject_match(projected_grid(self.grid, crs, resolution, shape), resampling, **options)


@dataclass(frozen=True)
class RasterSet:
    """Variables by name.  Those that share grid, type, nodata, keys and layout stand in one table with a key column `variable`,
    so that a warp shuffles once for each such group.  others: tables without both dimensions, passed through."""

    groups: tuple[RasterFrame, ...]
    names: dict[str, int]
    others: dict[str, DataFrame] = field(default_factory=dict)
    attrs: dict = field(default_factory=dict)

    @classmethod
    def of(cls, variables: dict[str, RasterFrame], others: dict[str, DataFrame] | None = None, attrs: dict | None = None) -> RasterSet:
        kinds: dict[tuple, list[str]] = {}
        for name, rf in variables.items():
            nodata = None if rf.nodata is None else repr(float(rf.nodata))  # NaN equals itself here
            kinds.setdefault((rf.grid, rf.dtype, nodata, rf.keys, rf.layout, rf.tile), []).append(name)
        groups = []
        for members in kinds.values():
            first = variables[members[0]]
            stacked = [variables[n].df.withColumn("variable", F.lit(n)) for n in members]
            groups.append(replace(first, df=functools.reduce(DataFrame.unionByName, stacked), keys=("variable", *first.keys), attrs={n: variables[n].attrs for n in members}))
        return cls(tuple(groups), {n: i for i, members in enumerate(kinds.values()) for n in members}, others or {}, attrs or {})

    def __getitem__(self, name: str) -> RasterFrame:
        if name not in self.names:
            raise KeyError(name)
        group = self.groups[self.names[name]]
        return replace(group, df=group.df.where(F.col("variable") == name).drop("variable"), keys=group.keys[1:], attrs=group.attrs.get(name, {}))

    @property
    def grid(self) -> Grid:
        grids = {g.grid for g in self.groups}
        if len(grids) != 1:
            raise ValueError("the variables have several grids" if grids else "there is no variable with both dimensions")
        return next(iter(grids))

    def reproject_match(self, other, resampling: str = "bilinear", **options) -> RasterSet:
        dst = Grid.of(other)
        out = []
        for g in self.groups:
            warped = replace(g, attrs={}).reproject_match(dst, resampling, **options)
            kept = {n: {k: v for k, v in a.items() if k not in ("crs", "transform", "spatial_ref", "spatial_ref_attrs")} | {"spatial_ref": dst.crs, "spatial_ref_attrs": spatial_ref(dst)} for n, a in g.attrs.items()}
            out.append(replace(warped, attrs=kept))
        attrs = {k: v for k, v in self.attrs.items() if k not in ("crs", "transform", "spatial_ref", "spatial_ref_attrs")} | {"spatial_ref": dst.crs, "spatial_ref_attrs": spatial_ref(dst)}
        return replace(self, groups=tuple(out), attrs=attrs)

    def reproject(self, crs: str, resolution=None, shape=None, resampling: str = "bilinear", **options) -> RasterSet:
        return self.reproject_match(projected_grid(self.grid, crs, resolution, shape), resampling, **options)


def mosaic(first: RasterFrame, *others: RasterFrame) -> RasterFrame:
    """Pixels of the first raster that has one; all on one grid."""
    parts = [first.to_pixels(), *(o.to_pixels() for o in others)]
    if any(p.grid != first.grid for p in parts):
        raise ValueError("rasters to merge need one grid")
    every = parts[0].df.withColumn("_p", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        every = every.unionByName(p.df.withColumn("_p", F.lit(i)))
    out = every.where("v is not null").groupBy(*first.keys, "row", "col").agg(F.min_by("v", "_p").alias("v"))
    return replace(parts[0], df=out)
