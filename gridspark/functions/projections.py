"""Projections as scalar programs (Snyder 1987; Karney 2011 for Transverse Mercator).

`forward(spec, lon, lat, tag)` and `inverse(spec, x, y, tag)` give steps and the two result names; angles in radians,
inverse iterations unrolled.  Points that a projection can't take come out as NaN or NULL, never as an error."""

from __future__ import annotations

import math

from gridspark.functions.crs import SPHERE, Projection, parse_crs
from gridspark.functions.exprs import Steps, lit, poly

#: fixed value: Web Mercator takes latitudes to here.
LAT_LIMIT = 1.4844222297453324

# fixed values: Krueger series to the sixth order in n, alpha for forward and beta for inverse
ALPHA = (
    (0, 1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    (0, 0, 13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    (0, 0, 0, 61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (0, 0, 0, 0, 49561 / 161280, -179 / 168, 6601661 / 7257600),
    (0, 0, 0, 0, 0, 34729 / 80640, -3418889 / 1995840),
    (0, 0, 0, 0, 0, 0, 212378941 / 319334400),
)
BETA = (
    (0, 1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
    (0, 0, 1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
    (0, 0, 0, 17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    (0, 0, 0, 0, 4397 / 161280, -11 / 504, -830251 / 7257600),
    (0, 0, 0, 0, 0, 4583 / 161280, -108847 / 3991680),
    (0, 0, 0, 0, 0, 0, 20648693 / 638668800),
)


# ---- numbers of a specification -----------------------------------------------------------------


def tsfn(phi: float, e: float) -> float:
    s = e * math.sin(phi)
    return math.tan(math.pi / 4 - phi / 2) / ((1 - s) / (1 + s)) ** (e / 2)


def msfn(phi: float, e2: float) -> float:
    return math.cos(phi) / math.sqrt(1 - e2 * math.sin(phi) ** 2)


def qsfn(phi: float, e: float) -> float:
    s = math.sin(phi)
    return (1 - e * e) * (s / (1 - (e * s) ** 2) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))


def _rectifying(p: Projection) -> float:
    return p.a / (1 + p.n) * poly([1, 0, 1 / 4, 0, 1 / 64, 0, 1 / 256], p.n)


def _cone(p: Projection) -> tuple[float, float, float]:
    """n, F and rho at the latitude of origin of a conformal cone."""
    f1, f2 = math.radians(p.lat1), math.radians(p.lat1 if p.lat2 is None else p.lat2)
    m1, t1 = msfn(f1, p.e2), tsfn(f1, p.e)
    n = math.sin(f1) if abs(f1 - f2) < 1e-10 else (math.log(m1) - math.log(msfn(f2, p.e2))) / (math.log(t1) - math.log(tsfn(f2, p.e)))
    big = m1 / (n * t1**n)
    return n, big, p.a * p.k0 * big * tsfn(math.radians(p.lat0), p.e) ** n


def _equal_area(p: Projection) -> tuple[float, float, float]:
    f1, f2 = math.radians(p.lat1), math.radians(p.lat1 if p.lat2 is None else p.lat2)
    m1, q1 = msfn(f1, p.e2), qsfn(f1, p.e)
    n = math.sin(f1) if abs(f1 - f2) < 1e-10 else (m1**2 - msfn(f2, p.e2) ** 2) / (qsfn(f2, p.e) - q1)
    c = m1**2 + n * q1
    return n, c, p.a * math.sqrt(abs(c - n * qsfn(math.radians(p.lat0), p.e))) / n


def _polar_scale(p: Projection) -> float:
    ts = abs(math.radians(p.lat_ts)) if p.lat_ts is not None else math.pi / 2
    if abs(ts - math.pi / 2) < 1e-10:
        return 2 * p.a * p.k0 / math.sqrt((1 + p.e) ** (1 + p.e) * (1 - p.e) ** (1 - p.e))
    return p.a * msfn(ts, p.e2) / tsfn(ts, p.e)


def _double(p: Projection) -> tuple[float, float, float, float]:
    """n, c, R and the conformal latitude of origin of the double stereographic projection (EPSG method 9809)."""
    f0 = math.radians(p.lat0)
    s = math.sin(f0)
    radius = p.a * math.sqrt(1 - p.e2) / (1 - p.e2 * s * s)
    n = math.sqrt(1 + p.e2 * math.cos(f0) ** 4 / (1 - p.e2))
    w1 = ((1 + s) / (1 - s) * ((1 - p.e * s) / (1 + p.e * s)) ** p.e) ** n
    sphere = (w1 - 1) / (w1 + 1)
    c = (n + s) * (1 - sphere) / ((n - s) * (1 + sphere))
    return n, c, radius, math.asin((c * w1 - 1) / (c * w1 + 1))


# ---- shared steps -------------------------------------------------------------------------------


def _tan_half(t: str, lat: str, e: float) -> Steps:
    """{t}: tan of half the conformal colatitude."""
    return [(f"{t}s", f"{lit(e)} * sin({lat})"), (t, f"tan({lit(math.pi / 4)} - {lat} / 2e0) / power((1e0 - {t}s) / (1e0 + {t}s), {lit(e / 2)})")]


def _lat_from_tan_half(out: str, t: str, e: float, rounds: int = 8) -> Steps:
    steps: Steps = [(f"{out}0", f"{lit(math.pi / 2)} - 2e0 * atan({t})")]
    for i in range(rounds):
        s = f"{lit(e)} * sin({out}{i})"
        steps += [(f"{out}q{i}", s), (f"{out}{i + 1}" if i < rounds - 1 else out, f"{lit(math.pi / 2)} - 2e0 * atan({t} * power((1e0 - {out}q{i}) / (1e0 + {out}q{i}), {lit(e / 2)}))")]
    return steps


def _series(coefficients, n: float, xi: str, eta: str, sin_or_cos: tuple[str, str], sgn: int) -> str:
    f, h = sin_or_cos
    terms = [f"{lit(sgn * poly(list(c), n))} * {f}({2 * j}e0 * {xi}) * {h}({2 * j}e0 * {eta})" for j, c in enumerate(coefficients, 1)]
    return " + ".join(terms)


# ---- projections --------------------------------------------------------------------------------


def forward(p: Projection, lon: str, lat: str, tag: str = "f") -> tuple[Steps, str, str]:
    x, y = f"{tag}_x", f"{tag}_y"
    lam = f"({lon} - {lit(math.radians(p.lon0))})"
    off = lambda body, at: f"{body} + {lit(at)}"
    if p.kind == "longlat":
        return [(x, f"degrees({lon})"), (y, f"degrees({lat})")], x, y
    if p.kind == "webmerc":
        phi = f"greatest({lit(-LAT_LIMIT)}, least({lit(LAT_LIMIT)}, {lat}))"
        return [(x, f"{lit(SPHERE)} * {lon}"), (y, f"{lit(SPHERE)} * ln(tan({lit(math.pi / 4)} + {phi} / 2e0))")], x, y
    if p.kind == "sinu":
        return [(x, off(f"{lit(p.a)} * {lam} * cos({lat})", p.x0)), (y, off(f"{lit(p.a)} * {lat}", p.y0))], x, y
    if p.kind == "eqc":
        k = p.a * math.cos(math.radians(p.lat_ts or 0.0))
        return [(x, off(f"{lit(k)} * {lam}", p.x0)), (y, off(f"{lit(p.a)} * ({lat} - {lit(math.radians(p.lat0))})", p.y0))], x, y
    t = f"{tag}_t"
    if p.kind == "merc":
        k = p.a * (msfn(math.radians(p.lat_ts), p.e2) if p.lat_ts else p.k0)
        return [*_tan_half(t, lat, p.e), (x, off(f"{lit(k)} * {lam}", p.x0)), (y, off(f"{lit(-k)} * ln({t})", p.y0))], x, y
    if p.kind == "lcc":
        n, big, rho0 = _cone(p)
        r, th = f"{tag}_r", f"{tag}_th"
        return [*_tan_half(t, lat, p.e), (r, f"{lit(p.a * p.k0 * big)} * power({t}, {lit(n)})"), (th, f"{lit(n)} * {lam}"), (x, off(f"{r} * sin({th})", p.x0)), (y, off(f"{lit(rho0)} - {r} * cos({th})", p.y0))], x, y
    if p.kind == "aea":
        n, c, rho0 = _equal_area(p)
        s, q, r, th = (f"{tag}_{v}" for v in ("s", "q", "r", "th"))
        e = p.e
        return [
            (s, f"sin({lat})"),
            (q, f"{lit(1 - p.e2)} * ({s} / (1e0 - {lit(p.e2)} * {s} * {s}) - ln((1e0 - {lit(e)} * {s}) / (1e0 + {lit(e)} * {s})) * {lit(1 / (2 * e))})"),
            (r, f"{lit(p.a / n)} * sqrt(abs({lit(c)} - {lit(n)} * {q}))"), (th, f"{lit(n)} * {lam}"),
            (x, off(f"{r} * sin({th})", p.x0)), (y, off(f"{lit(rho0)} - {r} * cos({th})", p.y0)),
        ], x, y
    if p.kind == "stere":
        north = p.lat0 > 0
        flip, k = f"{tag}_l", _polar_scale(p)
        return [(flip, lat if north else f"(0e0 - {lat})"), *_tan_half(t, flip, p.e), (x, off(f"{lit(k)} * {t} * sin{lam}", p.x0)), (y, off(f"{lit(-k if north else k)} * {t} * cos{lam}", p.y0))], x, y
    if p.kind == "sterea":
        n, c, radius, chi0 = _double(p)
        w, chi, th, bb = (f"{tag}_{v}" for v in ("w", "chi", "th", "bb"))
        k, s0, c0 = lit(2 * radius * p.k0), lit(math.sin(chi0)), lit(math.cos(chi0))
        return [
            *_tan_half(t, lat, p.e), (w, f"{lit(c)} * power({t}, {lit(-2 * n)})"), (chi, f"asin(({w} - 1e0) / ({w} + 1e0))"), (th, f"{lit(n)} * {lam}"),
            (bb, f"1e0 + sin({chi}) * {s0} + cos({chi}) * {c0} * cos({th})"),
            (x, off(f"{k} * cos({chi}) * sin({th}) / {bb}", p.x0)), (y, off(f"{k} * (sin({chi}) * {c0} - cos({chi}) * {s0} * cos({th})) / {bb}", p.y0)),
        ], x, y
    if p.kind == "tmerc":
        tau, sg, tp, xi, eta = (f"{tag}_{v}" for v in ("tau", "sg", "tp", "xi", "eta"))
        k = p.k0 * _rectifying(p)
        return [
            (tau, f"tan({lat})"),
            (sg, f"sinh({lit(p.e)} * atanh({lit(p.e)} * {tau} / sqrt(1e0 + {tau} * {tau})))"),
            (tp, f"{tau} * sqrt(1e0 + {sg} * {sg}) - {sg} * sqrt(1e0 + {tau} * {tau})"),
            (xi, f"atan2({tp}, cos{lam})"),
            (eta, f"asinh(sin{lam} / sqrt({tp} * {tp} + cos{lam} * cos{lam}))"),
            (x, off(f"{lit(k)} * ({eta} + {_series(ALPHA, p.n, xi, eta, ('cos', 'sinh'), 1)})", p.x0)),
            (y, off(f"{lit(k)} * ({xi} + {_series(ALPHA, p.n, xi, eta, ('sin', 'cosh'), 1)})", p.y0 - k * _xi0(p))),
        ], x, y
    raise ValueError(f"CRS not supported: {p.kind}")


def _xi0(p: Projection) -> float:
    """Rectified latitude of origin."""
    if not p.lat0:
        return 0.0
    tau = math.tan(math.radians(p.lat0))
    sg = math.sinh(p.e * math.atanh(p.e * tau / math.sqrt(1 + tau * tau)))
    xi = math.atan(tau * math.sqrt(1 + sg * sg) - sg * math.sqrt(1 + tau * tau))
    return xi + sum(poly(list(c), p.n) * math.sin(2 * j * xi) for j, c in enumerate(ALPHA, 1))


def inverse(p: Projection, x: str, y: str, tag: str = "i") -> tuple[Steps, str, str]:
    lon, lat = f"{tag}_lon", f"{tag}_lat"
    lon0 = lit(math.radians(p.lon0))
    dx, dy = f"({x} - {lit(p.x0)})", f"({y} - {lit(p.y0)})"
    if p.kind == "longlat":
        return [(lon, f"radians({x})"), (lat, f"radians({y})")], lon, lat
    if p.kind == "webmerc":
        return [(lon, f"{x} / {lit(SPHERE)}"), (lat, f"2e0 * atan(exp({y} / {lit(SPHERE)})) - {lit(math.pi / 2)}")], lon, lat
    if p.kind == "sinu":
        return [(lat, f"{dy} / {lit(p.a)}"), (lon, f"{lon0} + {dx} / ({lit(p.a)} * greatest(cos({lat}), 1e-15))")], lon, lat
    if p.kind == "eqc":
        k = p.a * math.cos(math.radians(p.lat_ts or 0.0))
        return [(lon, f"{lon0} + {dx} / {lit(k)}"), (lat, f"{dy} / {lit(p.a)} + {lit(math.radians(p.lat0))}")], lon, lat
    t = f"{tag}_t"
    if p.kind == "merc":
        k = p.a * (msfn(math.radians(p.lat_ts), p.e2) if p.lat_ts else p.k0)
        return [(t, f"exp((0e0 - {dy}) / {lit(k)})"), *_lat_from_tan_half(lat, t, p.e), (lon, f"{lon0} + {dx} / {lit(k)}")], lon, lat
    if p.kind == "lcc":
        n, big, rho0 = _cone(p)
        sgn = math.copysign(1.0, n)
        r, u = f"{tag}_r", f"{tag}_u"
        return [
            (u, f"{lit(rho0)} - {dy}"), (r, f"sqrt({dx} * {dx} + {u} * {u})"), (t, f"power({r} / {lit(abs(p.a * p.k0 * big))}, {lit(1 / n)})"),
            *_lat_from_tan_half(lat, t, p.e), (lon, f"{lon0} + atan2({lit(sgn)} * {dx}, {lit(sgn)} * {u}) / {lit(n)}"),
        ], lon, lat
    if p.kind == "aea":
        n, c, rho0 = _equal_area(p)
        sgn = math.copysign(1.0, n)
        u, q = f"{tag}_u", f"{tag}_q"
        steps: Steps = [(u, f"{lit(rho0)} - {dy}"), (q, f"({lit(c)} - ({dx} * {dx} + {u} * {u}) * {lit((n / p.a) ** 2)}) / {lit(n)}"), (f"{lat}0", f"asin(greatest(-1e0, least(1e0, {q} / 2e0)))")]
        for i in range(6):  # Newton on q(lat)
            s, w = f"{lat}s{i}", f"{lat}w{i}"
            at = f"{lat}{i}"
            steps += [
                (s, f"sin({at})"), (w, f"1e0 - {lit(p.e2)} * {s} * {s}"),
                (f"{lat}{i + 1}" if i < 5 else lat, f"{at} + {w} * {w} / (2e0 * greatest(cos({at}), 1e-15)) * ({q} * {lit(1 / (1 - p.e2))} - {s} / {w} + ln((1e0 - {lit(p.e)} * {s}) / (1e0 + {lit(p.e)} * {s})) * {lit(1 / (2 * p.e))})"),
            ]
        return [*steps, (lon, f"{lon0} + atan2({lit(sgn)} * {dx}, {lit(sgn)} * {u}) / {lit(n)}")], lon, lat
    if p.kind == "stere":
        north, k = p.lat0 > 0, _polar_scale(p)
        flip = f"{tag}_l"
        return [(t, f"sqrt({dx} * {dx} + {dy} * {dy}) / {lit(k)}"), *_lat_from_tan_half(flip, t, p.e), (lat, flip if north else f"0e0 - {flip}"), (lon, f"{lon0} + atan2({dx}, {lit(-1.0 if north else 1.0)} * {dy})")], lon, lat
    if p.kind == "sterea":
        n, c, radius, chi0 = _double(p)
        i, j, chi = (f"{tag}_{v}" for v in ("i", "j", "chi"))
        k = 2 * radius * p.k0
        g = k * math.tan(math.pi / 4 - chi0 / 2)
        h = 2 * k * math.tan(chi0) + g
        return [
            (i, f"atan({dx} / ({lit(h)} + {dy}))"), (j, f"atan({dx} / ({lit(g)} - {dy})) - {i}"), (chi, f"{lit(chi0)} + 2e0 * atan(({dy} - {dx} * tan({j} / 2e0)) / {lit(k)})"),
            (t, f"power((1e0 + sin({chi})) / ({lit(c)} * (1e0 - sin({chi}))), {lit(-1 / (2 * n))})"), *_lat_from_tan_half(lat, t, p.e), (lon, f"{lon0} + ({j} + 2e0 * {i}) / {lit(n)}"),
        ], lon, lat
    if p.kind == "tmerc":
        k = p.k0 * _rectifying(p)
        xi, eta, a, b, tp = (f"{tag}_{v}" for v in ("xi", "eta", "a", "b", "tp"))
        steps = [
            (xi, f"{dy} / {lit(k)} + {lit(_xi0(p))}"), (eta, f"{dx} / {lit(k)}"),
            (a, f"{xi} + {_series(BETA, p.n, xi, eta, ('sin', 'cosh'), -1)}"), (b, f"{eta} + {_series(BETA, p.n, xi, eta, ('cos', 'sinh'), -1)}"),
            (tp, f"sin({a}) / sqrt(sinh({b}) * sinh({b}) + cos({a}) * cos({a}))"), (f"{tag}_u0", tp),
        ]
        for i in range(4):  # Newton from the conformal to the geodetic tangent
            u, s, v = f"{tag}_u{i}", f"{tag}_s{i}", f"{tag}_v{i}"
            steps += [
                (s, f"sinh({lit(p.e)} * atanh({lit(p.e)} * {u} / sqrt(1e0 + {u} * {u})))"),
                (v, f"{u} * sqrt(1e0 + {s} * {s}) - {s} * sqrt(1e0 + {u} * {u})"),
                (f"{tag}_u{i + 1}", f"{u} + ({tp} - {v}) / sqrt(1e0 + {v} * {v}) * (1e0 + {lit(1 - p.e2)} * {u} * {u}) / ({lit(1 - p.e2)} * sqrt(1e0 + {u} * {u}))"),
            ]
        return [*steps, (lat, f"atan({tag}_u4)"), (lon, f"{lon0} + atan2(sinh({b}), cos({a}))")], lon, lat
    raise ValueError(f"CRS not supported: {p.kind}")


def between(src: str, dst: str, x: str, y: str, tag: str = "p") -> tuple[Steps, str, str]:
    """Steps from coordinates (x, y) in one CRS to the other; none where both are the same."""
    a, b = parse_crs(src), parse_crs(dst)
    if a == b:
        return [], x, y
    scale: Steps = []
    if a.unit != 1:
        scale = [(f"{tag}mx", f"{x} * {lit(a.unit)}"), (f"{tag}my", f"{y} * {lit(a.unit)}")]
        x, y = f"{tag}mx", f"{tag}my"
    back, lon, lat = inverse(a, x, y, f"{tag}i")
    ahead, u, v = forward(b, lon, lat, f"{tag}f")
    out = scale + back + ahead
    if b.unit != 1:
        out += [(f"{tag}ux", f"{u} / {lit(b.unit)}"), (f"{tag}uy", f"{v} / {lit(b.unit)}")]
        u, v = f"{tag}ux", f"{tag}uy"
    return out, u, v
