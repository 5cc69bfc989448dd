"""UTM <-> WGS84 by the Krueger series, as staged column expressions.

Each stage is its own projection so that shared terms are evaluated once.
Valid for EPSG 326zz (north) and 327zz (south).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# WGS84 ellipsoid and the UTM projection.
SEMI_MAJOR = 6378137.0
FLATTENING = 1.0 / 298.257223563
SCALE = 0.9996
FALSE_EASTING = 500000.0
SOUTH_NORTHING = 10000000.0

N1 = FLATTENING / (2.0 - FLATTENING)
RECTIFYING = SEMI_MAJOR / (1.0 + N1) * (1.0 + N1**2 / 4.0 + N1**4 / 64.0)
ECC = 2.0 * math.sqrt(N1) / (1.0 + N1)

# Series coefficients (forward, inverse, latitude), order 4.
ALPHA = (
    N1 / 2 - 2 * N1**2 / 3 + 5 * N1**3 / 16 + 41 * N1**4 / 180,
    13 * N1**2 / 48 - 3 * N1**3 / 5 + 557 * N1**4 / 1440,
    61 * N1**3 / 240 - 103 * N1**4 / 140,
    49561 * N1**4 / 161280,
)
BETA = (
    N1 / 2 - 2 * N1**2 / 3 + 37 * N1**3 / 96 - N1**4 / 360,
    N1**2 / 48 + N1**3 / 15 - 437 * N1**4 / 1440,
    17 * N1**3 / 480 - 37 * N1**4 / 840,
    4397 * N1**4 / 161280,
)
DELTA = (
    2 * N1 - 2 * N1**2 / 3 - 2 * N1**3 + 116 * N1**4 / 45,
    7 * N1**2 / 3 - 8 * N1**3 / 5 - 227 * N1**4 / 45,
    56 * N1**3 / 15 - 136 * N1**4 / 35,
    4279 * N1**4 / 630,
)


def central_meridian(epsg: Column) -> Column:
    return (epsg % 100) * 6 - 183


def false_northing(epsg: Column) -> Column:
    return F.when(F.floor(epsg / 100) == 327, F.lit(SOUTH_NORTHING)).otherwise(F.lit(0.0))


def _series(first: Column, coefficients: Sequence[float], term) -> Column:
    out = first
    for order, coefficient in enumerate(coefficients, start=1):
        out = out + F.lit(coefficient) * term(2 * order)
    return out


def with_lonlat(df: DataFrame, points: Sequence[tuple[str, str, str, str]], epsg: str = "epsg") -> DataFrame:
    """Add latitude/longitude columns for ``(easting, northing, lat, lon)`` names."""
    kept = df.columns
    stage = df
    for i, (east, north, _, _) in enumerate(points):
        stage = stage.withColumns({
            f"_xi{i}": (F.col(north) - false_northing(F.col(epsg))) / F.lit(SCALE * RECTIFYING),
            f"_eta{i}": (F.col(east) - F.lit(FALSE_EASTING)) / F.lit(SCALE * RECTIFYING),
        })
    turned = {}
    for i in range(len(points)):
        xi, eta = F.col(f"_xi{i}"), F.col(f"_eta{i}")
        turned[f"_xp{i}"] = _series(xi, [-b for b in BETA], lambda k: F.sin(F.lit(k) * xi) * F.cosh(F.lit(k) * eta))
        turned[f"_ep{i}"] = _series(eta, [-b for b in BETA], lambda k: F.cos(F.lit(k) * xi) * F.sinh(F.lit(k) * eta))
    stage = stage.withColumns(turned)
    spherical = {}
    for i in range(len(points)):
        xp, ep = F.col(f"_xp{i}"), F.col(f"_ep{i}")
        spherical[f"_chi{i}"] = F.asin(F.sin(xp) / F.cosh(ep))
        spherical[f"_dl{i}"] = F.atan2(F.sinh(ep), F.cos(xp))
    stage = stage.withColumns(spherical)
    out = {}
    for i, (_, _, lat, lon) in enumerate(points):
        chi = F.col(f"_chi{i}")
        out[lat] = F.degrees(_series(chi, DELTA, lambda k: F.sin(F.lit(k) * chi)))
        out[lon] = central_meridian(F.col(epsg)) + F.degrees(F.col(f"_dl{i}"))
    return stage.withColumns(out).select(*kept, *[n for p in points for n in p[2:]])


def with_utm(df: DataFrame, points: Sequence[tuple[str, str, str, str]], epsg: str = "epsg") -> DataFrame:
    """Add easting/northing columns for ``(lat, lon, easting, northing)`` names."""
    kept = df.columns
    stage = df
    first = {}
    for i, (lat, lon, _, _) in enumerate(points):
        first[f"_s{i}"] = F.sin(F.radians(F.col(lat)))
        first[f"_dl{i}"] = F.radians(F.col(lon) - central_meridian(F.col(epsg)))
    stage = stage.withColumns(first)
    stage = stage.withColumns({
        f"_t{i}": F.sinh(F.atanh(F.col(f"_s{i}")) - F.lit(ECC) * F.atanh(F.lit(ECC) * F.col(f"_s{i}")))
        for i in range(len(points))
    })
    spherical = {}
    for i in range(len(points)):
        t, dl = F.col(f"_t{i}"), F.col(f"_dl{i}")
        spherical[f"_xp{i}"] = F.atan2(t, F.cos(dl))
        spherical[f"_ep{i}"] = F.atanh(F.sin(dl) / F.sqrt(F.lit(1.0) + t * t))
    stage = stage.withColumns(spherical)
    out = {}
    for i, (_, _, east, north) in enumerate(points):
        xp, ep = F.col(f"_xp{i}"), F.col(f"_ep{i}")
        out[east] = F.lit(FALSE_EASTING) + F.lit(SCALE * RECTIFYING) * _series(
            ep, ALPHA, lambda k: F.cos(F.lit(k) * xp) * F.sinh(F.lit(k) * ep))
        out[north] = false_northing(F.col(epsg)) + F.lit(SCALE * RECTIFYING) * _series(
            xp, ALPHA, lambda k: F.sin(F.lit(k) * xp) * F.cosh(F.lit(k) * ep))
    return stage.withColumns(out).select(*kept, *[n for p in points for n in p[2:]])


def pixel_to_map(origin_e: Column, origin_n: Column, y: Column, x: Column, metres: int) -> tuple[Column, Column]:
    """Upper-left corner of a pixel in the scene's own projection."""
    return origin_e + x * F.lit(metres), origin_n - y * F.lit(metres)


def round_coord(value: Column, decimals: int = 6) -> Column:
    """Decimal rounding of a coordinate (half to even)."""
    scale = F.lit(float(10**decimals))
    return F.rint(value * scale) / scale
