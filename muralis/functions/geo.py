"""Geodesy and plane geometry as Catalyst expressions. Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def rounded(x: Column, digits: int = 6) -> Column:
    """Half-up rounding by plain arithmetic, so that engines with other rounding rules can repeat it."""
    return F.floor(x * F.lit(10.0**digits) + F.lit(0.5)) / F.lit(10.0**digits)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2.0) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2.0)
    return 2.0 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def angle_delta(a: Column, b: Column) -> Column:
    """Difference of two bearings, in [0, 180] degrees."""
    d = F.pmod(a - b, F.lit(360.0))
    return F.least(d, 360.0 - d)


def bearing_of(x: Column, y: Column) -> Column:
    """Compass bearing of a vector (east, north), in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(x, y)), F.lit(360.0))


def compass(bearing: Column) -> Column:
    """One of eight compass points."""
    points = F.array(*map(F.lit, ("N", "NE", "E", "SE", "S", "SW", "W", "NW")))
    return F.element_at(points, (F.pmod(F.floor((bearing + 22.5) / 45.0), F.lit(8)) + 1).cast("int"))


def local_xy(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Metres east and north of (lat0, lon0), equirectangular."""
    return F.radians(lon - lon0) * EARTH_M * F.cos(F.radians(lat0)), F.radians(lat - lat0) * EARTH_M


def segment_parameter(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Where the foot of (px, py) falls on the segment a-b, clamped to [0, 1]."""
    square = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    t = ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / square
    return F.when(square == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), t)))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    t = segment_parameter(px, py, ax, ay, bx, by)
    return F.sqrt(F.pow(px - (ax + t * (bx - ax)), 2.0) + F.pow(py - (ay + t * (by - ay)), 2.0))


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180.0) / 6.0) + 1).cast("int")


def utm(lat: Column, lon: Column) -> tuple[Column, Column]:
    """WGS84 easting and northing in the point's own zone, by the Krüger series to the third order (millimetres)."""
    f, a = 1 / 298.257223563, 6378.137
    n = f / (2 - f)
    big_a = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * n**0.5 / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - ((utm_zone(lon) - 1) * 6.0 - 177.0))
    s = F.sin(phi)
    atanh = lambda x: 0.5 * F.log((1 + x) / (1 - x))
    t = F.sinh(atanh(s) - e * atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(alpha, 1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    k0 = 0.9996
    return 1000 * (500 + k0 * big_a * east), 1000 * (k0 * big_a * north + F.when(lat < 0, 10_000.0).otherwise(0.0))


def dms_to_degrees(d: Column, m: Column, s: Column, hemisphere: Column) -> Column:
    """Degrees, minutes and seconds; negative in the south and west."""
    return (d + m / 60.0 + s / 3600.0) * F.when(F.upper(hemisphere).isin("S", "W"), -1.0).otherwise(1.0)
