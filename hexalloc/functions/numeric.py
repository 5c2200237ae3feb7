"""Numeric column expressions: rounding, clipping, means, distances and projections."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the Earth in metres; WGS 84 axis and flattening.
EARTH_RADIUS_M = 6_371_008.8
WGS84_A, WGS84_F = 6_378_137.0, 1 / 298.257223563


def rint_to(x: Column, digits: int) -> Column:
    """Round half to even by scaling, as array libraries do."""
    scale = float(10**digits)
    return F.rint(x * scale) / scale


def round_half_up(x: Column, digits: int) -> Column:
    """Rounds values of 0 or more by scaling, as SQL engines do; ``round`` of a double goes over a decimal
    number, which costs many times as much."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / F.lit(scale)


def clip(x: Column, low: Column | float, high: Column | float) -> Column:
    """Bounds that keep nulls (``least`` and ``greatest`` alone skip them)."""
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def is_constant(low: Column, high: Column) -> Column:
    """Range test relative to the size of the values."""
    return (high - low) <= 1e-12 * F.greatest(F.lit(1.0), F.abs(high), F.abs(low))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator != 0, numerator / denominator)


def weighted_geometric_mean(parts: dict[str, Column], exponents: dict[str, float]) -> Column:
    """exp(sum of w * ln x); 0 as soon as one part is 0 or less. Exponents must add up to 1."""
    if abs(sum(exponents.values()) - 1) > 1e-9:
        raise ValueError(f"exponents add up to {sum(exponents.values())}, not 1")
    if parts.keys() != exponents.keys():
        raise ValueError("parts and exponents must have the same names")
    logs = reduce(lambda a, b: a + b, (F.lit(float(exponents[k])) * F.ln(parts[k]) for k in parts))
    return F.when(F.least(*parts.values()) <= 0, 0.0).otherwise(F.exp(logs))


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, cos1: Column | None = None, cos2: Column | None = None) -> Column:
    """``cos1`` and ``cos2``: cosines of the latitudes, where they are known for each point."""
    cos1, cos2 = F.cos(F.radians(lat1)) if cos1 is None else cos1, F.cos(F.radians(lat2)) if cos2 is None else cos2
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + cos1 * cos2 * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def ellipsoidal_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, circuity: float = 1.0) -> Column:
    """Short distances by the two radii of curvature at the middle latitude."""
    e2 = WGS84_F * (2 - WGS84_F)
    phi = F.radians((lat1 + lat2) / 2)
    w = F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    north = WGS84_A * (1 - e2) / F.pow(w, 3) * F.radians(lat2 - lat1)
    east = WGS84_A / w * F.cos(phi) * F.radians(lon2 - lon1)
    return F.sqrt(north * north + east * east) * circuity


def utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing (northern hemisphere) by Krueger's series to the third order."""
    n = WGS84_F / (2 - WGS84_F)
    a = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    k0, e = 0.9996, math.sqrt(WGS84_F * (2 - WGS84_F))
    phi, lam = F.radians(lat), F.radians(lon - (6 * zone - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(alpha, 1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500_000 + k0 * a * east, k0 * a * north


def planar_m(x1: Column, y1: Column, x2: Column, y2: Column, circuity: float = 1.0) -> Column:
    """Distance in a plane, for coordinates that were projected once for each point."""
    if circuity < 1:
        raise ValueError("a route is never shorter than the straight line")
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) * circuity


def utm_distance_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, zone: int, circuity: float = 1.0) -> Column:
    return planar_m(*utm(lon1, lat1, zone), *utm(lon2, lat2, zone), circuity)


def fisher_interval(rho: Column, n: Column) -> tuple[Column, Column]:
    """95 % interval of a rank correlation; null for n < 4 or |rho| = 1."""
    usable = (n >= 4) & (F.abs(rho) < 1)
    se = F.sqrt(1.06 / (n - 3))
    return tuple(F.when(usable, F.tanh(F.atanh(rho) + s * 1.96 * se)) for s in (-1, 1))


def scaled_dn(dn: Column, qa: Column, mask: int, gain: float, offset: float) -> Column:
    """Digital numbers to degrees Celsius; null where a masked QA bit is set or the number is 0."""
    bad = (qa.bitwiseAND(F.lit(mask).cast("long")) != 0) | (dn == 0)
    return F.when(~bad, dn * gain + offset - 273.15)


def qa_mask(bits) -> int:
    """One mask of all bits that spoil an observation."""
    return reduce(lambda m, b: m | 1 << b, bits, 0)
