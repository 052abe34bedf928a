"""Grid projection and areas on the ellipsoid and the sphere.

The transverse-Mercator series is the published Krueger expansion to fourth
order; it is available as column expressions and as a NumPy inverse for the
outline step.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: WGS 84 ellipsoid, grid scale and false origin
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, FALSE_EAST, FALSE_NORTH = 0.9996, 500_000.0, 10_000_000.0
SPHERE_RADIUS = 6378137.0

_N = FLATTENING / (2 - FLATTENING)
_E2 = FLATTENING * (2 - FLATTENING)
_E = math.sqrt(_E2)
_RECT = SEMI_MAJOR / (1 + _N) * (1 + _N ** 2 / 4 + _N ** 4 / 64)
_ALPHA = (
    _N / 2 - 2 * _N ** 2 / 3 + 5 * _N ** 3 / 16 + 41 * _N ** 4 / 180,
    13 * _N ** 2 / 48 - 3 * _N ** 3 / 5 + 557 * _N ** 4 / 1440,
    61 * _N ** 3 / 240 - 103 * _N ** 4 / 140,
    49561 * _N ** 4 / 161280,
)
_BETA = (
    _N / 2 - 2 * _N ** 2 / 3 + 37 * _N ** 3 / 96 - _N ** 4 / 360,
    _N ** 2 / 48 + _N ** 3 / 15 - 437 * _N ** 4 / 1440,
    17 * _N ** 3 / 480 - 37 * _N ** 4 / 840,
    4397 * _N ** 4 / 161280,
)


def grid_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def epsg_code(lon: Column, lat: Column) -> Column:
    return F.when(lat < 0, 32700).otherwise(32600) + grid_zone(lon)


def project_points(points: Column, zone: Column, south: Column) -> Column:
    """Array of ``(lon, lat)`` structs to ``(x, y)`` in metres of a grid zone.

    One transform per stage of the series, so every intermediate value is
    computed once per point instead of being repeated inside the next formula.
    """
    sines = F.transform(points, lambda p: F.struct(
        F.sin(F.radians(p["lat"])).alias("s"), F.radians(p["lon"] - (zone * 6 - 183)).alias("lam")))
    conformal = F.transform(sines, lambda p: F.struct(
        F.sinh(F.atanh(p["s"]) - F.lit(_E) * F.atanh(F.lit(_E) * p["s"])).alias("t"), p["lam"].alias("lam")))
    angles = F.transform(conformal, lambda p: F.struct(
        F.atan2(p["t"], F.cos(p["lam"])).alias("xi"),
        F.atanh(F.sin(p["lam"]) / F.sqrt(F.lit(1.0) + p["t"] * p["t"])).alias("eta")))

    def metres(p: Column) -> Column:
        north, east = p["xi"], p["eta"]
        for j, a in enumerate(_ALPHA, 1):
            k = F.lit(2.0 * j)
            north = north + F.lit(a) * F.sin(k * p["xi"]) * F.cosh(k * p["eta"])
            east = east + F.lit(a) * F.cos(k * p["xi"]) * F.sinh(k * p["eta"])
        y = F.lit(SCALE * _RECT) * north + F.when(south, F.lit(FALSE_NORTH)).otherwise(F.lit(0.0))
        return F.struct((F.lit(FALSE_EAST) + F.lit(SCALE * _RECT) * east).alias("x"), y.alias("y"))

    return F.transform(angles, metres)


def project(lon: Column, lat: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Easting and northing in metres of the given grid zone."""
    point = F.get(project_points(F.array(F.struct(lon.alias("lon"), lat.alias("lat"))), zone, south), F.lit(0))
    return point["x"], point["y"]


def unproject(x: np.ndarray, y: np.ndarray, zone: int, south: bool) -> tuple[np.ndarray, np.ndarray]:
    """Longitude and latitude of grid coordinates."""
    xi = (y - (FALSE_NORTH if south else 0.0)) / (SCALE * _RECT)
    eta = (x - FALSE_EAST) / (SCALE * _RECT)
    xi0, eta0 = xi.copy(), eta.copy()
    for j, b in enumerate(_BETA, 1):
        xi0 -= b * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
        eta0 -= b * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
    tau_c = np.sin(xi0) / np.hypot(np.sinh(eta0), np.cos(xi0))
    lam = np.arctan2(np.sinh(eta0), np.cos(xi0))
    # conformal to geographic latitude by a few Newton-like corrections
    tau = tau_c.copy()
    for _ in range(6):
        sigma = np.sinh(_E * np.arctanh(_E * tau / np.sqrt(1 + tau * tau)))
        guess = tau * np.sqrt(1 + sigma * sigma) - sigma * np.sqrt(1 + tau * tau)
        slope = (np.sqrt((1 + guess * guess) * (1 + tau * tau)) * (1 - _E2) / (1 + (1 - _E2) * tau * tau))
        tau += (tau_c - guess) / slope
    return np.degrees(lam) + zone * 6 - 183, np.degrees(np.arctan(tau))
