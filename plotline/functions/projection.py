"""Transverse Mercator (UTM) to and from geographic coordinates, as column expressions.

Krueger's series in the third flattening, to fourth order: well below a millimetre within a zone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS 84 and UTM.
A, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, FALSE_EASTING, FALSE_NORTHING_SOUTH = 0.9996, 500000.0, 10000000.0

N = FLATTENING / (2 - FLATTENING)
RADIUS = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ALPHA = (
    N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180, 13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440,
    61 * N**3 / 240 - 103 * N**4 / 140, 49561 * N**4 / 161280,
)
BETA = (
    N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360, N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440,
    17 * N**3 / 480 - 37 * N**4 / 840, 4397 * N**4 / 161280,
)
DELTA = (
    2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45, 7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45,
    56 * N**3 / 15 - 136 * N**4 / 35, 4279 * N**4 / 630,
)


def central_meridian(zone: int) -> float:
    return 6.0 * zone - 183.0


def utm_to_lonlat(easting: Column, northing: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of UTM coordinates."""
    xi = (northing - (FALSE_NORTHING_SOUTH if south else 0.0)) / (SCALE * RADIUS)
    eta = (easting - FALSE_EASTING) / (SCALE * RADIUS)
    xi_, eta_ = xi, eta
    for j, b in enumerate(BETA, 1):
        xi_ = xi_ - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta_ = eta_ - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi_) / F.cosh(eta_))
    lat = chi
    for j, d in enumerate(DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return central_meridian(zone) + F.degrees(F.atan2(F.sinh(eta_), F.cos(xi_))), F.degrees(lat)


def lonlat_to_utm(lon: Column, lat: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Easting and northing of longitude and latitude in degrees."""
    e = 2 * math.sqrt(N) / (1 + N)
    phi, lam = F.radians(lat), F.radians(lon - central_meridian(zone))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi_, eta_ = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    xi, eta = xi_, eta_
    for j, a in enumerate(ALPHA, 1):
        xi = xi + a * F.sin(2 * j * xi_) * F.cosh(2 * j * eta_)
        eta = eta + a * F.cos(2 * j * xi_) * F.sinh(2 * j * eta_)
    return FALSE_EASTING + SCALE * RADIUS * eta, (FALSE_NORTHING_SOUTH if south else 0.0) + SCALE * RADIUS * xi
