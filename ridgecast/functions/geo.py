"""Distances, projections, grid indices and outlines as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
KM_PER_DEGREE = 111.32

# WGS84 and the third flattening's series for transverse Mercator (Krueger), fixed values.
_A, _F = 6378137.0, 1 / 298.257223563
_N = _F / (2 - _F)
_E = math.sqrt(_F * (2 - _F))
_RECT = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_K0 = 0.9996


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    s1, s2 = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = s1 * s1 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s2 * s2
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def valid_coordinate(lat: Column, lon: Column) -> Column:
    """Both present and on the globe."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def utm_zone(lon: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(60), F.floor((lon + 180) / 6) + 1)).cast("int")


def utm_epsg(lat: Column, zone: Column) -> Column:
    return (F.when(lat >= 0, 32600).otherwise(32700) + zone).cast("int")


def hemisphere(lat: Column) -> Column:
    return F.when(lat >= 0, "N").otherwise("S")


def utm_forward(lat: Column, lon: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing in metres on the zone's grid."""
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(_E) * F.atanh(F.lit(_E) * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + _K0 * _RECT * x, F.when(lat < 0, 1e7).otherwise(0.0) + _K0 * _RECT * y


def utm_inverse(easting: Column, northing: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a grid point."""
    xi0 = (northing - F.when(south, 1e7).otherwise(0.0)) / (_K0 * _RECT)
    eta0 = (easting - 500000) / (_K0 * _RECT)
    xi, eta = xi0, eta0
    for j, b in enumerate(_BETA, 1):
        xi = xi - b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.degrees(lat), zone * 6 - 183 + F.degrees(F.atan2(F.sinh(eta), F.cos(xi)))


def pixel_index(coordinate: Column, origin: Column, step: Column) -> Column:
    """The cell that holds a coordinate; just below the origin is -1, not 0."""
    return F.floor((coordinate - origin) / step).cast("int")


def tile_lat(lat: Column) -> Column:
    return F.floor(lat).cast("int")


def tile_key(lat: Column, lon: Column) -> Column:
    """The one-degree tile by its south-west corner."""
    la, lo = F.floor(lat).cast("int"), F.floor(lon).cast("int")
    return F.concat(F.when(la < 0, "s").otherwise("n"), F.lpad(F.abs(la).cast("string"), 2, "0"), F.when(lo < 0, "w").otherwise("e"), F.lpad(F.abs(lo).cast("string"), 3, "0"))


def circle_ring(lat: Column, lon: Column, radius_km: Column, points: int = 72) -> Column:
    """Boundary points (k, lat, lon) of a circle."""
    degrees = radius_km / KM_PER_DEGREE
    shrink = F.greatest(F.cos(F.radians(lat)), F.lit(1e-6))
    angle = lambda k: F.radians(k * F.lit(360.0 / points))
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.struct(k.alias("k"), (lat + degrees * F.cos(angle(k))).alias("lat"), (lon + degrees * F.sin(angle(k)) / shrink).alias("lon")))
