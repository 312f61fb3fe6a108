"""Inverse projections to longitude and latitude: UTM zones on WGS84, and web Mercator."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

#: The WGS84 ellipsoid, and UTM's scale and false easting and northing.
A, FLATTENING = 6_378_137.0, 1 / 298.257223563
K0, EAST_0, NORTH_0 = 0.9996, 500_000.0, 10_000_000.0

Inverse = Callable[[float, float], tuple[float, float]]


def web_mercator(x: float, y: float) -> tuple[float, float]:
    return math.degrees(x / A), math.degrees(2 * math.atan(math.exp(y / A)) - math.pi / 2)


def utm(zone: int, south: bool) -> Inverse:
    """Inverse transverse Mercator by series in the third flattening, to the third order: millimetres within a zone."""
    n = FLATTENING / (2 - FLATTENING)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    back = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    lat_of = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    meridian = zone * 6 - 183

    def inverse(x: float, y: float) -> tuple[float, float]:
        xi, eta = (y - (NORTH_0 if south else 0.0)) / (K0 * radius), (x - EAST_0) / (K0 * radius)
        xi1 = xi - sum(b * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, b in enumerate(back, 1))
        eta1 = eta - sum(b * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, b in enumerate(back, 1))
        chi = math.asin(math.sin(xi1) / math.cosh(eta1))
        lat = chi + sum(d * math.sin(2 * j * chi) for j, d in enumerate(lat_of, 1))
        return meridian + math.degrees(math.atan2(math.sinh(eta1), math.cos(xi1))), math.degrees(lat)

    return inverse


def inverse(crs: str | None) -> Inverse | None:
    """The way back to degrees from a declared system (EPSG 326xx, 327xx, 3857, or the text of a .prj), or null."""
    t = (crs or "").upper()
    code = re.search(r"EPSG\D*(\d{4,6})\D*$", t.replace(" ", "")) or re.search(r'AUTHORITY\["EPSG","?(\d{4,6})"?\]\]\s*$', t)
    if code:
        n = int(code.group(1))
        if n in (3857, 900913):
            return web_mercator
        if 1 <= n % 100 <= 60 and n // 100 in (326, 327):
            return utm(n % 100, n // 100 == 327)
    zone = re.search(r"UTM[ _]?ZONE[ _]?(\d{1,2})([NS])", t)
    if zone and 1 <= int(zone.group(1)) <= 60:
        return utm(int(zone.group(1)), zone.group(2) == "S")
    return web_mercator if "WEB_MERCATOR" in t or "PSEUDO-MERCATOR" in t else None
