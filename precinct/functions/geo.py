"""Point, text and projection expressions. x is longitude, y is latitude."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WGS84 = "EPSG:4326"
WEB_MERCATOR = "EPSG:3857"
EARTH_RADIUS_M = 6378137.0
KM_PER_DEGREE = 111.0
# Centre shown when a map has no data (geographic centre of the US).
DEFAULT_CENTRE = (39.8283, -98.5795)

NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
_WKT_POINT = rf"(?i)^\s*POINT\s*\(\s*({NUMBER})\s+({NUMBER})\s*\)\s*$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def point(lon: Column | str, lat: Column | str) -> Column:
    """struct<x, y>, null unless both coordinates are present."""
    lon, lat = col(lon), col(lat)
    return F.when(lon.isNotNull() & lat.isNotNull(), F.struct(lon.alias("x"), lat.alias("y")))


def to_wkt(lon: Column | str, lat: Column | str) -> Column:
    """POINT text at full precision, null when a coordinate is missing."""
    lon, lat = col(lon), col(lat)
    text = F.concat(F.lit("POINT ("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")"))
    return F.when(lon.isNotNull() & lat.isNotNull(), text)


def from_wkt(text: Column | str) -> Column:
    """struct<x, y> of a POINT text; blank, missing-like and malformed text gives null."""
    text = col(text)
    x = F.regexp_extract(text, _WKT_POINT, 1).try_cast("double")
    y = F.regexp_extract(text, _WKT_POINT, 2).try_cast("double")
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def out_of_range(lat: Column | str, lon: Column | str) -> Column:
    """True only for a present value beyond ±90 / ±180; the limits themselves are fine."""
    lat, lon = col(lat), col(lon)
    bad = (F.abs(lat) > 90) | (F.abs(lon) > 180)
    return F.coalesce(bad, F.lit(False))


def within_box(lat: Column | str, lon: Column | str, centre: tuple[float, float], radius_km: float) -> Column:
    """Inside the degree square of half side radius/111 around `centre` (lat, lon)."""
    reach = radius_km / KM_PER_DEGREE
    at_lat, at_lon = centre
    return col(lat).between(at_lat - reach, at_lat + reach) & col(lon).between(
        at_lon - reach, at_lon + reach
    )


def mercator(lon: Column | str, lat: Column | str) -> tuple[Column, Column]:
    """Degrees to Web Mercator metres."""
    x = F.radians(col(lon)) * EARTH_RADIUS_M
    y = F.log(F.tan(F.lit(3.141592653589793 / 4) + F.radians(col(lat)) / 2)) * EARTH_RADIUS_M
    return x, y


def unmercator(x: Column | str, y: Column | str) -> tuple[Column, Column]:
    """Web Mercator metres to degrees (lon, lat)."""
    lon = F.degrees(col(x) / EARTH_RADIUS_M)
    lat = F.degrees(F.atan(F.exp(col(y) / EARTH_RADIUS_M)) * 2 - 3.141592653589793 / 2)
    return lon, lat


def reproject(x: Column | str, y: Column | str, source: str, target: str) -> tuple[Column, Column]:
    if source == target:
        return col(x), col(y)
    if (source, target) == (WGS84, WEB_MERCATOR):
        return mercator(x, y)
    if (source, target) == (WEB_MERCATOR, WGS84):
        return unmercator(x, y)
    raise ValueError(f"cannot reproject {source} to {target}")
