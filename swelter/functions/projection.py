"""Oblique Lambert azimuthal equal-area projection on the WGS84 ellipsoid, in km."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Semi-major axis in km and flattening of WGS84.
A, FLAT = 6378.137, 1 / 298.257223563
E2 = FLAT * (2 - FLAT)
E1 = math.sqrt(E2)


def _q(sin_lat: float) -> float:
    return (1 - E2) * (sin_lat / (1 - E2 * sin_lat**2) - math.log((1 - E1 * sin_lat) / (1 + E1 * sin_lat)) / (2 * E1))


@dataclass(frozen=True)
class Constants:
    qp: float
    sin_b0: float
    cos_b0: float
    rq: float
    d: float


def constants(lon0: float, lat0: float) -> Constants:
    """What belongs to a centre: q at the pole, its authalic latitude, the sphere's radius and the scale."""
    qp, s0 = _q(1.0), math.sin(math.radians(lat0))
    b0 = math.asin(_q(s0) / qp)
    rq = A * math.sqrt(qp / 2)
    d = A * math.cos(math.radians(lat0)) / math.sqrt(1 - E2 * s0**2) / (rq * math.cos(b0))
    return Constants(qp, math.sin(b0), math.cos(b0), rq, d)


def inverse(x: Column, y: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    """(lon, lat) of points of the plane; the centre's own is the centre.

    The authalic latitude is turned back by its series (Snyder 1987, equation 3-18) and
    then by STEPS of Newton's method on q, which end within the rounding of a double.
    """
    k0 = constants(lon0, lat0)
    qp, rq, d = k0.qp, k0.rq, k0.d
    u, v = x / d, y * d
    rho = F.sqrt(u * u + v * v)
    c = 2 * F.asin(F.least(F.lit(1.0), rho / (2 * rq)))
    away = rho > 0
    q = qp * F.when(away, F.cos(c) * k0.sin_b0 + v * F.sin(c) * k0.cos_b0 / rho).otherwise(k0.sin_b0)
    b = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / qp)))
    series = (E2 / 3 + 31 * E2**2 / 180 + 517 * E2**3 / 5040, 23 * E2**2 / 360 + 251 * E2**3 / 3780, 761 * E2**3 / 45360)
    lat = b + series[0] * F.sin(2 * b) + series[1] * F.sin(4 * b) + series[2] * F.sin(6 * b)

    def step(at: Column, _: Column) -> Column:
        s = F.sin(at)
        w = 1 - E2 * s * s
        more = w * w / (2 * F.cos(at)) * (q / (1 - E2) - s / w + F.log((1 - E1 * s) / (1 + E1 * s)) / (2 * E1))
        return at + F.when(F.cos(at) > 1e-12, more).otherwise(0.0)

    lat = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), lat, step)
    east = F.atan2(u * F.sin(c), rho * k0.cos_b0 * F.cos(c) - v * k0.sin_b0 * F.sin(c))
    return lon0 + F.when(away, F.degrees(east)).otherwise(0.0), F.degrees(lat)


STEPS = 4


def forward(lon: Column, lat: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    """(x, y) of places, by authalic latitudes (Snyder 1987, equations 3-12, 24-17 to 24-20)."""
    k0 = constants(lon0, lat0)
    qp, rq, d = k0.qp, k0.rq, k0.d
    s = F.sin(F.radians(lat))
    q = (1 - E2) * (s / (1 - E2 * s * s) - F.log((1 - E1 * s) / (1 + E1 * s)) / (2 * E1))
    b = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / qp)))
    dl = F.radians(lon - lon0)
    k = F.sqrt(2 / (1 + k0.sin_b0 * F.sin(b) + k0.cos_b0 * F.cos(b) * F.cos(dl))) * rq
    return k * d * F.cos(b) * F.sin(dl), k / d * (k0.cos_b0 * F.sin(b) - k0.sin_b0 * F.cos(b) * F.cos(dl))
