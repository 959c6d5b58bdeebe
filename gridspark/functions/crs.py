"""Coordinate reference systems: EPSG codes and PROJ strings to projection specifications.  Driver-side only.

Geodetic coordinates count as equal whatever the ellipsoid (no datum shift; a datum or `towgs84` that asks for one is refused),
longitudes are not wrapped."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, replace

#: fixed values: semi-major axis and inverse flattening.
ELLIPSOIDS = {
    "WGS84": (6378137.0, 298.257223563),
    "GRS80": (6378137.0, 298.257222101),
    "WGS72": (6378135.0, 298.26),
    "GRS67": (6378160.0, 298.2471674270),
    "AUST_SA": (6378160.0, 298.25),
    "AIRY": (6377563.396, 299.3249646),
    "BESSEL": (6377397.155, 299.1528128),
    "CLRK66": (6378206.4, 294.9786982138982),
    "CLRK80IGN": (6378249.2, 293.4660212936269),
    "INTL": (6378388.0, 297.0),
    "KRASS": (6378245.0, 298.3),
}
#: fixed values: metres in a unit of length.
UNITS = {"m": 1.0, "km": 1000.0, "cm": 0.01, "ft": 0.3048, "us-ft": 1200 / 3937, "yd": 0.9144, "mi": 1609.344, "kmi": 1852.0}
#: Datums whose geodetic coordinates count as those of WGS84.
DATUMS = {"WGS84": "WGS84", "NAD83": "GRS80", "ETRS89": "GRS80", "GRS80": "GRS80", "GDA94": "GRS80"}
SPHERE = 6378137.0


@dataclass(frozen=True)
class Projection:
    """kind: longlat, webmerc, tmerc, lcc, aea, stere, sterea, merc, eqc, sinu.  Angles in degrees, lengths in metres but for
    coordinates, which are in units of `unit` metres.  size (semi-major axis, inverse flattening) replaces the ellipsoid's."""

    kind: str
    ellps: str = "WGS84"
    lon0: float = 0.0
    lat0: float = 0.0
    lat1: float | None = None
    lat2: float | None = None
    lat_ts: float | None = None
    k0: float = 1.0
    x0: float = 0.0
    y0: float = 0.0
    unit: float = 1.0
    size: tuple[float, float] | None = None
    name: str = field(default="", compare=False)

    @property
    def a(self) -> float:
        return (self.size or ELLIPSOIDS[self.ellps])[0]

    @property
    def f(self) -> float:
        return 1 / (self.size or ELLIPSOIDS[self.ellps])[1]

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)

    @property
    def e(self) -> float:
        return math.sqrt(self.e2)

    @property
    def n(self) -> float:
        return self.f / (2 - self.f)


def _utm(zone: int, south: bool) -> Projection:
    return Projection("tmerc", lon0=(zone - 1) * 6 - 177.0, k0=0.9996, x0=500000.0, y0=1e7 if south else 0.0)


def epsg(code: int) -> Projection:
    """fixed values: parameters of the EPSG registry."""
    if 32601 <= code <= 32660:
        return _utm(code - 32600, False)
    if 32701 <= code <= 32760:
        return _utm(code - 32700, True)
    for first, last, base, south in ((25828, 25838, 25800, False), (26901, 26923, 26900, False), (28348, 28358, 28300, True), (7846, 7859, 7800, True)):  # ETRS89, NAD83, GDA94, GDA2020
        if first <= code <= last:
            return replace(_utm(code - base, south), ellps="GRS80")
    table = {
        4326: Projection("longlat"),
        4258: Projection("longlat", ellps="GRS80"),
        4269: Projection("longlat", ellps="GRS80"),
        3857: Projection("webmerc"),
        3395: Projection("merc"),
        4087: Projection("eqc"),
        32662: Projection("eqc"),
        2154: Projection("lcc", ellps="GRS80", lon0=3, lat0=46.5, lat1=49, lat2=44, x0=700000, y0=6600000),
        3034: Projection("lcc", ellps="GRS80", lon0=10, lat0=52, lat1=35, lat2=65, x0=4000000, y0=2800000),
        5070: Projection("aea", ellps="GRS80", lon0=-96, lat0=23, lat1=29.5, lat2=45.5),
        3577: Projection("aea", ellps="GRS80", lon0=132, lat0=0, lat1=-18, lat2=-36),
        3031: Projection("stere", lon0=0, lat0=-90, lat_ts=-71),
        3413: Projection("stere", lon0=-45, lat0=90, lat_ts=70),
        3995: Projection("stere", lon0=0, lat0=90, lat_ts=71),
        3996: Projection("stere", lon0=0, lat0=90, lat_ts=75),
        3976: Projection("stere", lon0=0, lat0=-90, lat_ts=-70),
        32661: Projection("stere", lat0=90, k0=0.994, x0=2000000, y0=2000000),
        32761: Projection("stere", lat0=-90, k0=0.994, x0=2000000, y0=2000000),
        2193: Projection("tmerc", ellps="GRS80", lon0=173, k0=0.9996, x0=1600000, y0=10000000),
        3338: Projection("aea", ellps="GRS80", lon0=-154, lat0=50, lat1=55, lat2=65),
        3005: Projection("aea", ellps="GRS80", lon0=-126, lat0=45, lat1=50, lat2=58.5, x0=1000000),
        3310: Projection("aea", ellps="GRS80", lon0=-120, lat0=0, lat1=34, lat2=40.5, y0=-4000000),
        3978: Projection("lcc", ellps="GRS80", lon0=-95, lat0=49, lat1=49, lat2=77),
        3347: Projection("lcc", ellps="GRS80", lon0=-(91 + 52 / 60), lat0=63.390675, lat1=49, lat2=77, x0=6200000, y0=3000000),
    }
    if code not in table:
        raise ValueError(f"CRS not supported: EPSG:{code}")
    return table[code]


def _proj_string(text: str) -> Projection:
    args = {}
    for part in text.split():
        key, _, value = part.lstrip("+").partition("=")
        args[key] = value
    if "init" in args:
        return parse_crs(args["init"])
    datum = args.get("datum", "").upper()
    if datum and datum not in DATUMS or any(float(x or 0) for x in args.get("towgs84", "").split(",")):
        raise ValueError(f"CRS not supported: datum shift in {text!r}")
    ellps = args.get("ellps", DATUMS.get(datum, "WGS84")).upper()
    ellps = DATUMS.get(ellps, ellps)
    if ellps not in ELLIPSOIDS:
        raise ValueError(f"CRS not supported: ellipsoid {ellps} in {text!r}")
    if args.get("units", "m") not in UNITS:
        raise ValueError(f"CRS not supported: units in {text!r}")
    unit = float(args["to_meter"]) if "to_meter" in args else UNITS[args.get("units", "m")]
    num = lambda k, d=None: float(args[k]) if k in args else d
    kind = args.get("proj", "")
    kind = {"latlong": "longlat", "latlon": "longlat", "lonlat": "longlat"}.get(kind, kind)
    if kind == "utm":
        zone = int(args.get("zone", 0))
        if not 1 <= zone <= 60:
            raise ValueError(f"CRS not supported: zone in {text!r}")
        return replace(_utm(zone, "south" in args), ellps=ellps, unit=unit)
    if kind not in ("longlat", "tmerc", "merc", "lcc", "aea", "stere", "sterea", "sinu", "eqc"):
        raise ValueError(f"CRS not supported: {text!r}")
    a, b, size = num("a"), num("b"), None
    if kind == "merc" and a is not None and a == b == SPHERE:
        return Projection("webmerc")
    if a is not None:
        rf = num("rf", a / (a - b) if b is not None and b != a else None)
        if rf is None:
            raise ValueError(f"CRS not supported: a sphere in {text!r}")
        size = (a, rf)
    lat1 = num("lat_1", num("lat_0") if kind == "lcc" else None)
    if kind in ("lcc", "aea") and lat1 is None:
        raise ValueError(f"CRS not supported: lat_1 is missing in {text!r}")
    spec = Projection(kind, ellps, num("lon_0", 0.0), num("lat_0", lat1 if kind == "lcc" and "lat_0" not in args else 0.0), lat1, num("lat_2", lat1), num("lat_ts"), num("k_0", num("k", 1.0)), num("x_0", 0.0), num("y_0", 0.0), unit if kind != "longlat" else 1.0, size)
    if kind == "stere" and abs(spec.lat0) != 90:
        raise ValueError(f"CRS not supported: oblique stereographic {text!r}")
    return spec


_AUTHORITY = re.compile(r'(?:ID\["EPSG",\s*(\d+)\]|AUTHORITY\["EPSG",\s*"(\d+)"\])\s*\]\s*$')


def from_wkt(wkt: str) -> str:
    """`EPSG:n` of a WKT that ends with its code, else the WKT as it is (which parse_crs refuses)."""
    m = _AUTHORITY.search(wkt)
    return f"EPSG:{m[1] or m[2]}" if m else wkt


def crs_of(attrs: dict | None = None, spatial_ref: dict | None = None) -> str:
    """The CRS that a dataset's metadata name: spatial_ref's `epsg`, then its `crs_wkt`, then the attribute `crs`."""
    ref, attrs = spatial_ref or {}, attrs or {}
    if ref.get("epsg") is not None:
        return f"EPSG:{int(ref['epsg'])}"
    if ref.get("crs_wkt"):
        return from_wkt(str(ref["crs_wkt"]))
    if attrs.get("crs") is not None:
        return from_wkt(str(attrs["crs"]))
    raise ValueError("no CRS is named: neither spatial_ref (epsg, crs_wkt) nor the attribute crs")


def parse_crs(crs: str) -> Projection:
    """`EPSG:n`, `epsg:n`, a PROJ string or a WKT that ends with its EPSG code; ValueError names what isn't supported."""
    crs = from_wkt(crs)
    if crs.startswith(("EPSG:", "epsg:")):
        code = crs[5:]
        if not code.isdigit():
            raise ValueError(f"CRS not supported: {crs!r}")
        return epsg(int(code))
    if "+proj=" in crs or "+init=" in crs:
        return _proj_string(crs)
    raise ValueError(f"CRS not supported: {crs!r}")
