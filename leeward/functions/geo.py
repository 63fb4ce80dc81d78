from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_KM = 6371.0
KM_PER_DEGREE = 111.19492664455873
MOLLWEIDE_R = 6378137.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from point 1 to point 2, clockwise from north, in [0, 360)."""
    dlon = F.radians(lon2 - lon1)
    p1, p2 = F.radians(lat1), F.radians(lat2)
    y = F.sin(dlon) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(y, x)) + F.lit(360.0), F.lit(360.0))


def local_xy_m(lat0: Column, lon0: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """East and north offsets in metres on the plane that touches the earth at the first point."""
    per_degree = F.lit(KM_PER_DEGREE * 1000)
    return (lon - lon0) * per_degree * F.cos(F.radians(lat0)), (lat - lat0) * per_degree


def sector_of(degrees: Column, sectors: int = 16) -> Column:
    width = 360.0 / sectors
    return (F.floor(F.pmod(degrees + F.lit(width / 2), F.lit(360.0)) / F.lit(width))).cast("long")


def mollweide_to_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    """Closed-form inverse of the Mollweide projection (EPSG:54009), in degrees."""
    theta = F.asin(y / F.lit(MOLLWEIDE_R * 2 ** 0.5))
    lat = F.asin((F.lit(2.0) * theta + F.sin(F.lit(2.0) * theta)) / F.lit(3.141592653589793))
    lon = F.lit(3.141592653589793) * x / (F.lit(2 * 2 ** 0.5 * MOLLWEIDE_R) * F.cos(theta))
    return F.degrees(lon), F.degrees(lat)


def snap(value: Column, step: float) -> Column:
    """Centre of the lattice interval the value falls into."""
    return (F.floor(value / F.lit(step)) + F.lit(0.5)) * F.lit(step)
