"""Geometry as Column arithmetic: projection, bearings, distances."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ellipsoid GRS80 and the UTM constants of zone 32 north (EPSG:25832).
SEMI_MAJOR_M = 6378137.0
FLATTENING = 1 / 298.257222101
SCALE = 0.9996
FALSE_EASTING_M = 500000.0
CENTRAL_MERIDIAN_DEG = 9.0


def krueger() -> tuple[float, float, list[float]]:
    """Rectifying radius, twice the root ratio, and the series factors to third order in n."""
    n = FLATTENING / (2 - FLATTENING)
    radius = SEMI_MAJOR_M / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    e = 2 * math.sqrt(n) / (1 + n)
    series = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    return radius, e, series


def conformal(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Tangent of the conformal latitude, and the longitude from the central meridian in radians."""
    _, e, _ = krueger()
    s = F.sin(F.radians(lat))
    return F.sinh(F.atanh(s) - F.lit(e) * F.atanh(F.lit(e) * s)), F.radians(lon - F.lit(CENTRAL_MERIDIAN_DEG))


def on_sphere(t: Column, d: Column) -> tuple[Column, Column]:
    return F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(F.lit(1.0) + t * t))


def on_plane(xi: Column, eta: Column) -> tuple[Column, Column]:
    radius, _, series = krueger()
    x, y = eta, xi
    for j, a in enumerate(series, 1):
        k = F.lit(2.0 * j)
        x = x + F.lit(a) * F.cos(k * xi) * F.sinh(k * eta)
        y = y + F.lit(a) * F.sin(k * xi) * F.cosh(k * eta)
    return F.lit(FALSE_EASTING_M) + F.lit(SCALE * radius) * x, F.lit(SCALE * radius) * y


def utm32(lat: Column, lon: Column) -> tuple[Column, Column]:
    """WGS84 degrees to metric x, y in EPSG:25832; null in gives null out."""
    return on_plane(*on_sphere(*conformal(lat, lon)))


def with_utm32(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Adds x, y as utm32(), but NaN where lat or lon is null, so that they are never null.

    They are worked out in steps of their own, as in one expression each inner term would come many times. For the same
    reason they aren't nullable: the filters that the optimizer infers for nullable keys and operands would repeat it all.
    """
    t, d = conformal(F.col(lat), F.col(lon))
    xi, eta = on_sphere(F.col("_utm_t"), F.col("_utm_d"))
    x, y = on_plane(F.col("_utm_xi"), F.col("_utm_eta"))
    steps = df.withColumns({"_utm_t": t, "_utm_d": d}).withColumns({"_utm_xi": xi, "_utm_eta": eta})
    nan = F.lit(float("nan"))
    return steps.withColumns({"x": F.coalesce(x, nan), "y": F.coalesce(y, nan)}).drop("_utm_t", "_utm_d", "_utm_xi", "_utm_eta")


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    dx, dy = x1 - x0, y1 - y0
    return F.sqrt(dx * dx + dy * dy)


def point_segment_distance(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance from a point to a segment; a segment of no length counts as a point."""
    dx, dy = x1 - x0, y1 - y0
    ll = dx * dx + dy * dy
    along = F.coalesce(F.try_divide((px - x0) * dx + (py - y0) * dy, ll), F.lit(0.0))
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return distance(px, py, x0 + u * dx, y0 + u * dy)


def compass_bearing(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north in [0, 360); no movement gives 0."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def axis_angle(a: Column, b: Column) -> Column:
    """Smallest angle between two undirected axes, in [0, 90]."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, F.lit(180.0) - d)
