"""Geodesics on the WGS84 ellipsoid by Vincenty's series, vectorised; sound for points that are not nearly antipodal."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

A, FLAT = 6378137.0, 1 / 298.257223563
B = A * (1 - FLAT)


def _series(cos2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = cos2 * (A * A - B * B) / (B * B)
    return 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))), u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))


def _delta(big: np.ndarray, s: np.ndarray, c: np.ndarray, c2m: np.ndarray) -> np.ndarray:
    return big * s * (c2m + big / 4 * (c * (2 * c2m**2 - 1) - big / 6 * c2m * (4 * s * s - 3) * (4 * c2m**2 - 3)))


def inverse(lon1, lat1, lon2, lat2) -> tuple[np.ndarray, np.ndarray]:
    """(azimuth 0 ... 360, distance in metres); equal points have azimuth 0 and distance 0."""
    lon1, lat1, lon2, lat2 = (np.asarray(x, float) for x in (lon1, lat1, lon2, lat2))
    u1, u2 = (np.arctan((1 - FLAT) * np.tan(np.radians(x))) for x in (lat1, lat2))
    diff = np.radians((lon2 - lon1 + 540) % 360 - 180)
    lam = diff.copy() if diff.ndim else np.array(float(diff))
    for _ in range(60):
        x, y = np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam)
        s, c = np.hypot(x, y), np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
        sigma = np.arctan2(s, c)
        with np.errstate(invalid="ignore", divide="ignore"):
            sa = np.where(s > 0, np.cos(u1) * np.cos(u2) * np.sin(lam) / np.where(s > 0, s, 1), 0)
            ca2 = 1 - sa * sa
            c2m = np.where(ca2 > 1e-15, c - 2 * np.sin(u1) * np.sin(u2) / np.where(ca2 > 1e-15, ca2, 1), 0)
        k = FLAT / 16 * ca2 * (4 + FLAT * (4 - 3 * ca2))
        new = diff + (1 - k) * FLAT * sa * (sigma + k * s * (c2m + k * c * (2 * c2m**2 - 1)))
        if np.all(np.abs(new - lam) < 1e-13):
            lam = new
            break
        lam = new
    a, b = _series(ca2)
    return np.degrees(np.arctan2(x, y)) % 360, B * a * (sigma - _delta(b, s, c, c2m))


def direct(lon, lat, az, dist) -> tuple[np.ndarray, np.ndarray]:
    """(lon, lat) at a distance along an azimuth."""
    lon, lat, az, dist = (np.asarray(x, float) for x in (lon, lat, az, dist))
    t = (1 - FLAT) * np.tan(np.radians(lat))
    a1, u1 = np.radians(az), np.arctan(t)
    first = np.arctan2(t, np.cos(a1))
    sa = np.cos(u1) * np.sin(a1)
    ca2 = 1 - sa * sa
    a, b = _series(ca2)
    sigma = dist / (B * a)
    for _ in range(60):
        c2m = np.cos(2 * first + sigma)
        new = dist / (B * a) + _delta(b, np.sin(sigma), np.cos(sigma), c2m)
        if np.all(np.abs(new - sigma) < 1e-13):
            break
        sigma = new
    s, c, c2m = np.sin(sigma), np.cos(sigma), np.cos(2 * first + sigma)
    z = np.sin(u1) * s - np.cos(u1) * c * np.cos(a1)
    out = np.arctan2(np.sin(u1) * c + np.cos(u1) * s * np.cos(a1), (1 - FLAT) * np.hypot(sa, z))
    lam = np.arctan2(s * np.sin(a1), np.cos(u1) * c - np.sin(u1) * s * np.cos(a1))
    k = FLAT / 16 * ca2 * (4 + FLAT * (4 - 3 * ca2))
    return lon + np.degrees(lam - (1 - k) * FLAT * sa * (sigma + k * s * (c2m + k * c * (2 * c2m**2 - 1)))), np.degrees(out)


def inverse_column():
    """(lon1, lat1, lon2, lat2) -> struct(az, dist)."""

    @F.pandas_udf(T.StructType([T.StructField("az", T.DoubleType()), T.StructField("dist", T.DoubleType())]))
    def run(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.DataFrame:
        az, dist = inverse(lon1, lat1, lon2, lat2)
        return pd.DataFrame({"az": az, "dist": dist})

    return run


def direct_column():
    """(lon, lat, az, dist) -> struct(lon, lat)."""

    @F.pandas_udf(T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())]))
    def run(lon: pd.Series, lat: pd.Series, az: pd.Series, dist: pd.Series) -> pd.DataFrame:
        x, y = direct(lon, lat, az, dist)
        return pd.DataFrame({"lon": x, "lat": y})

    return run
