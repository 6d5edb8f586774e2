"""Numeric helpers as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def safe_ratio(num: Column, den: Column, least: float = 1e-8) -> Column:
    """num / den, null where the denominator is too small."""
    return F.when(F.abs(den) > least, num / den)


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def relu(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def finite(c: Column) -> Column:
    """c, null where it is NaN or infinite: NaN would win every maximum and be counted by medians."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_RADIUS_M) -> Column:
    """Great-circle distance; the term under the root is held within 0 and 1."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(clip(a, 0.0, 1.0)))


def utm_northing_easting(lat: Column, lon: Column, central_meridian: float) -> tuple[Column, Column]:
    """Transverse Mercator (x, y) in metres on WGS 84 by the usual series; x has the false easting of 500 km."""
    a, f, k0 = 6_378_137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    phi, dl = F.radians(lat), F.radians(lon - F.lit(central_meridian))
    n = F.lit(a) / F.sqrt(1 - F.lit(e2) * F.pow(F.sin(phi), 2))
    t, c, aa = F.pow(F.tan(phi), 2), F.lit(ep2) * F.pow(F.cos(phi), 2), dl * F.cos(phi)
    m = F.lit(a) * (
        F.lit(1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
        - F.lit(3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + F.lit(15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi)
        - F.lit(35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    x = F.lit(k0) * n * (aa + (1 - t + c) * F.pow(aa, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * F.pow(aa, 5) / 120) + 500_000.0
    y = F.lit(k0) * (
        m + n * F.tan(phi) * (aa * aa / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(aa, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * F.pow(aa, 6) / 720)
    )
    return x, y
