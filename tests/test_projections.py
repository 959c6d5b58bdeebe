"""Published points: worked examples of EPSG Guidance Note 7-2 and of Snyder, Map Projections - A Working Manual (1987)."""

import numpy as np
import pytest

from gridspark.functions.crs import parse_crs
from gridspark.plans.grid import transform


def dms(d, m=0.0, s=0.0):
    return np.copysign(abs(d) + m / 60 + s / 3600, d)


POINTS = [  # CRS, longitude, latitude, x, y, tolerance in its units
    ("EPSG:3857", dms(-100, 20), dms(24, 22, 54.433), -11169055.58, 2800000.00, 0.01),  # EPSG 1024
    ("EPSG:32633", 15.0, 60.0, 500000.0, 6651411.190, 0.01),
    ("EPSG:32617", dms(-79, 23, 13.7), dms(43, 38, 33.24), 630084, 4833438, 1.0),  # CN Tower
    ("+proj=tmerc +lon_0=-75 +k_0=0.9996 +ellps=clrk66", -73.5, 40.5, 127106.5, 4484124.4, 0.1),  # Snyder p. 269
    ("+proj=tmerc +lat_0=49 +lon_0=-2 +k_0=0.9996012717 +x_0=400000 +y_0=-100000 +ellps=airy", 0.5, 50.5, 577274.99, 69740.50, 0.05),  # EPSG 9807
    ("+proj=merc +lon_0=180 +ellps=clrk66", 285.0, 35.0, 11688673.7, 4139145.6, 0.1),  # Snyder p. 267
    ("+proj=merc +lon_0=110 +k_0=0.997 +x_0=3900000 +y_0=900000 +ellps=bessel", 120.0, -3.0, 5009726.58, 569150.82, 0.01),  # EPSG 9804
    ("+proj=lcc +lat_1=33 +lat_2=45 +lat_0=23 +lon_0=-96 +ellps=clrk66", -75.0, 35.0, 1894410.9, 1564649.5, 0.1),  # Snyder p. 296
    ("+proj=lcc +lat_1=18 +lat_0=18 +lon_0=-77 +k_0=1 +x_0=250000 +y_0=150000 +ellps=clrk66", dms(-76, 56, 37.26), dms(17, 55, 55.80), 255966.58, 142493.51, 0.01),  # EPSG 9801
    ("+proj=lcc +lat_1=28.3833333333333 +lat_2=30.2833333333333 +lat_0=27.8333333333333 +lon_0=-99 +x_0=609601.2192024384 +y_0=0 +ellps=clrk66 +units=us-ft", -96.0, 28.5, 2963503.91, 254759.80, 0.05),  # EPSG 9802
    ("+proj=aea +lat_1=29.5 +lat_2=45.5 +lat_0=23 +lon_0=-96 +ellps=clrk66", -75.0, 35.0, 1885472.7, 1535925.0, 0.1),  # Snyder p. 292
    ("+proj=stere +lat_0=-90 +lat_ts=-71 +lon_0=70 +x_0=6000000 +y_0=6000000", 120.0, -75.0, 7255380.79, 7053389.56, 0.01),  # EPSG 9829
    ("+proj=stere +lat_0=-90 +lat_ts=-71 +lon_0=-100 +ellps=intl", 150.0, -75.0, -1540033.6, -560526.4, 0.1),  # Snyder p. 316
    ("EPSG:32661", 44.0, 73.0, 3320416.75, 632668.43, 0.01),  # EPSG 9810
    ("+proj=sterea +lat_0=52.1561605555556 +lon_0=5.38763888888889 +k_0=0.9999079 +x_0=155000 +y_0=463000 +ellps=bessel", 6.0, 53.0, 196105.283, 557057.739, 0.01),  # EPSG 9809
]


@pytest.mark.parametrize("crs, lon, lat, x, y, near", POINTS)
def test_published_points(crs, lon, lat, x, y, near):
    u, v = transform("EPSG:4326", crs, [lon], [lat])
    assert u[0] == pytest.approx(x, abs=near) and v[0] == pytest.approx(y, abs=near)
    a, b = transform(crs, "EPSG:4326", [x], [y])
    metres = near * parse_crs(crs).unit
    assert (a[0] - lon + 180) % 360 - 180 == pytest.approx(0, abs=metres / 30000) and b[0] == pytest.approx(lat, abs=metres / 50000)


def test_there_and_back():
    rng = np.random.default_rng(2)
    for crs in ("EPSG:2193", "EPSG:3338", "EPSG:3005", "EPSG:3310", "EPSG:3978", "EPSG:3347", "EPSG:3976", "EPSG:3996", "EPSG:26917", "EPSG:28355", "EPSG:7855", "+proj=sinu +units=km", "+proj=utm +zone=31 +ellps=intl +units=us-ft", "+proj=eqc +a=6378249.145 +rf=293.465"):
        p = parse_crs(crs)
        south = p.lat0 < 0 or p.y0 == 10000000
        lon, lat = p.lon0 + rng.uniform(-2.5, 2.5, 200), rng.uniform(30, 60, 200) * (-1 if south else 1)
        a, b = transform(crs, "EPSG:4326", *transform("EPSG:4326", crs, lon, lat))
        assert np.allclose(a, lon, atol=1e-9) and np.allclose(b, lat, atol=1e-9), crs


def test_what_is_refused():
    for crs in ("+proj=utm +zone=33 +datum=NAD27", "+proj=lcc +lat_1=50 +towgs84=1,2,3", "+proj=merc +a=6370997 +b=6370997", "+proj=merc +units=parsec", "+proj=laea +lat_0=52", "+proj=stere +lat_0=40", "+proj=merc +ellps=moon"):
        with pytest.raises(ValueError, match="not supported"):
            parse_crs(crs)
