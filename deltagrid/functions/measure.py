"""Distances, bearings, projections and the sun, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

M_PER_DEGREE, RADIUS_KM = 111_320.0, 6371.0


def haversine_km(lat0: Column, lon0: Column, lat1: Column, lon1: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat1 - lat0) / 2), 2) + F.cos(F.radians(lat0)) * F.cos(F.radians(lat1)) * F.pow(F.sin(F.radians(lon1 - lon0) / 2), 2)
    return 2 * RADIUS_KM * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def flat_m(lat0: Column, lon0: Column, lat1: Column, lon1: Column) -> Column:
    """Flat metres, with the cosine of the mean latitude."""
    dx = (lon1 - lon0) * F.cos(F.radians((lat0 + lat1) / 2))
    dy = lat1 - lat0
    return F.sqrt(dx * dx + dy * dy) * M_PER_DEGREE


def bearing(lat0: Column, lon0: Column, lat1: Column, lon1: Column) -> Column:
    """Degrees clockwise from north, 0 to 360, flat."""
    return F.pmod(F.degrees(F.atan2((lon1 - lon0) * F.cos(F.radians((lat0 + lat1) / 2)), lat1 - lat0)), F.lit(360.0))


def uv_distance2(du: Column, dv: Column) -> Column:
    """Squared length of a diamond offset; the axes meet at 60 degrees."""
    return du * du + dv * dv + du * dv


def river_weight(cms: Column) -> Column:
    return F.least(F.greatest((F.log10(F.greatest(cms, F.lit(0.01))) + 2) / 6, F.lit(0.0)), F.lit(1.0))


def quantize_elevation(m: Column) -> Column:
    """Half metres above -11,000, cut; 65535 for none."""
    return F.when(m.isNull(), 65535).otherwise(F.least(F.greatest(((m + 11000) * 2).cast("int"), F.lit(0)), F.lit(65534)))


def dequantize_elevation(q: Column) -> Column:
    return F.when(q != 65535, q / 2.0 - 11000)


def utm(lat: Column, lon: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing in a northern zone (WGS84), by the usual series to the sixth power."""
    a, f, k0 = 6_378_137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    phi = F.radians(lat)
    n = a / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    t, c = F.pow(F.tan(phi), 2), ep2 * F.pow(F.cos(phi), 2)
    big = F.cos(phi) * F.radians(lon - (zone * 6 - 183))
    arc = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi) - (35 * e2**3 / 3072) * F.sin(6 * phi))
    east = 500_000 + k0 * n * (big + (1 - t + c) * F.pow(big, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * F.pow(big, 5) / 120)
    north = k0 * (arc + n * F.tan(phi) * (F.pow(big, 2) / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(big, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * F.pow(big, 6) / 720))
    return east, north


def sun(lat: Column, lon: Column, unix: Column) -> tuple[Column, Column]:
    """Azimuth and altitude in degrees (NOAA's equations)."""
    century = (unix / 86400.0 + 2440587.5 - 2451545.0) / 36525
    long0 = F.pmod(280.46646 + century * (36000.76983 + century * 0.0003032), F.lit(360.0))
    anomaly = F.radians(357.52911 + century * (35999.05029 - 0.0001537 * century))
    ecc = 0.016708634 - century * (0.000042037 + 0.0000001267 * century)
    centre = F.sin(anomaly) * (1.914602 - century * (0.004817 + 0.000014 * century)) + F.sin(2 * anomaly) * (0.019993 - 0.000101 * century) + F.sin(3 * anomaly) * 0.000289
    node = F.radians(125.04 - 1934.136 * century)
    apparent = F.radians(long0 + centre - 0.00569 - 0.00478 * F.sin(node))
    tilt = F.radians(23 + (26 + (21.448 - century * (46.815 + century * (0.00059 - century * 0.001813))) / 60) / 60 + 0.00256 * F.cos(node))
    decl = F.asin(F.sin(tilt) * F.sin(apparent))
    y = F.pow(F.tan(tilt / 2), 2)
    l0 = F.radians(long0)
    minutes = 4 * F.degrees(y * F.sin(2 * l0) - 2 * ecc * F.sin(anomaly) + 4 * ecc * y * F.sin(anomaly) * F.cos(2 * l0) - 0.5 * y * y * F.sin(4 * l0) - 1.25 * ecc * ecc * F.sin(2 * anomaly))
    hour = F.radians(F.pmod(F.pmod(unix / 60.0, F.lit(1440.0)) + minutes + 4 * lon, F.lit(1440.0)) / 4 - 180)
    phi = F.radians(lat)
    altitude = F.asin(F.sin(phi) * F.sin(decl) + F.cos(phi) * F.cos(decl) * F.cos(hour))
    azimuth = F.pmod(F.degrees(F.atan2(F.sin(hour), F.cos(hour) * F.sin(phi) - F.tan(decl) * F.cos(phi))) + 180, F.lit(360.0))
    return azimuth, F.degrees(altitude)
