"""Map projections as Column expressions, from published closed forms: Lambert azimuthal equal area for EPSG:3035 and
transverse Mercator (Krüger series, third order and more) for UTM north zones EPSG:326zz. Accuracy is about a
millimetre; the shift between ETRS89 and WGS84 is taken as nil. Other systems raise ValueError."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

A, FLAT = 6378137.0, 1 / 298.257222101
A84, FLAT84 = 6378137.0, 1 / 298.257223563


def _zone(crs: str) -> int:
    code = crs.upper().removeprefix("EPSG:")
    if len(code) == 5 and code.startswith("326") and 1 <= int(code[3:]) <= 60:
        return int(code[3:])
    raise ValueError(f"no projection for {crs}: EPSG:3035 and EPSG:32601 to 32660 are built in")


def forward(lon: Column, lat: Column, crs: str) -> tuple[Column, Column]:
    """Easting and northing of WGS84 degrees."""
    return _laea(lon, lat) if crs.upper() == "EPSG:3035" else _utm(lon, lat, _zone(crs))


def _laea(lon: Column, lat: Column) -> tuple[Column, Column]:
    e2 = FLAT * (2 - FLAT)
    e = math.sqrt(e2)
    lat0, lon0, fe, fn = math.radians(52), math.radians(10), 4321000.0, 3210000.0
    of = lambda s: (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))
    qp, q0 = of(1.0), of(math.sin(lat0))
    rq, beta0 = A * math.sqrt(qp / 2), math.asin(q0 / qp)
    d = A * math.cos(lat0) / math.sqrt(1 - e2 * math.sin(lat0) ** 2) / (rq * math.cos(beta0))
    s = F.sin(F.radians(lat))
    q = (s / (1 - s * s * e2) - F.log((1 - s * e) / (1 + s * e)) / (2 * e)) * (1 - e2)
    beta, dl = F.asin(q / qp), F.radians(lon) - lon0
    b = F.sqrt(F.lit(2.0) / (1 + F.sin(beta) * math.sin(beta0) + F.cos(beta) * F.cos(dl) * math.cos(beta0))) * rq
    return b * d * F.cos(beta) * F.sin(dl) + fe, b / d * (F.sin(beta) * math.cos(beta0) - F.cos(beta) * F.cos(dl) * math.sin(beta0)) + fn


def _series() -> tuple[float, list[float], list[float], list[float]]:
    """Radius of rectifying sphere times scale, and the coefficients forward, back, and of the conformal latitude."""
    n = FLAT84 / (2 - FLAT84)
    radius = 0.9996 * A84 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180 - 127 * n**5 / 288 + 7891 * n**6 / 37800,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440 + 281 * n**5 / 630 - 1983433 * n**6 / 1935360,
        61 * n**3 / 240 - 103 * n**4 / 140 + 15061 * n**5 / 26880 + 167603 * n**6 / 181440,
        49561 * n**4 / 161280 - 179 * n**5 / 168 + 6601661 * n**6 / 7257600,
        34729 * n**5 / 80640 - 3418889 * n**6 / 1995840,
        212378941 * n**6 / 319334400,
    ]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
    return radius, alpha, beta, delta


def _utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    radius, alpha, _, _ = _series()
    e = math.sqrt(FLAT84 * (2 - FLAT84))
    dl = F.radians(lon) - math.radians(zone * 6 - 183)
    s = F.sin(F.radians(lat))
    atanh = lambda v: F.log((1 + v) / (1 - v)) / 2
    t = F.sinh(atanh(s) - atanh(s * e) * e)
    xi, eta = F.atan2(t, F.cos(dl)), atanh(F.sin(dl) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for k, a in enumerate(alpha, 1):
        x = x + F.cos(xi * (2 * k)) * F.sinh(eta * (2 * k)) * a
        y = y + F.sin(xi * (2 * k)) * F.cosh(eta * (2 * k)) * a
    return x * radius + 500000.0, y * radius


def inverse(x: Column, y: Column, crs: str) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of UTM north coordinates; null for a northing of more than half the way around the globe, which is no place."""
    zone = _zone(crs)
    radius, _, beta, delta = _series()
    xi0, eta0 = F.when(F.abs(y / radius) <= math.pi, y / radius), (x - 500000.0) / radius
    xi, eta = xi0, eta0
    for k, b in enumerate(beta, 1):
        xi = xi - F.sin(xi0 * (2 * k)) * F.cosh(eta0 * (2 * k)) * b
        eta = eta - F.cos(xi0 * (2 * k)) * F.sinh(eta0 * (2 * k)) * b
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi
    for k, d in enumerate(delta, 1):
        lat = lat + F.sin(chi * (2 * k)) * d
    return F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + float(zone * 6 - 183), F.degrees(lat)
