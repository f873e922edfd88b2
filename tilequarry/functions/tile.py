"""Tile algebra as column expressions: degrees, tile indices, metres and fixed-point units.

All stay inside whole-stage code generation. Southern latitudes and both poles are handled; bounds
are always named columns, never tuples.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius of the sphere of web Mercator in metres, its latitude limit, kilometres per degree.
RADIUS = 6378137.0
MAX_LAT = 85.0511287798066
KM_PER_DEGREE = 111.32


def tiles_across(zoom: Column) -> Column:
    """Tiles on an axis at a zoom."""
    return F.expr("1L").cast("long") * F.pow(F.lit(2.0), zoom).cast("long")


def _index(part: Column, zoom: Column) -> Column:
    n = tiles_across(zoom)
    return F.greatest(F.lit(0).cast("long"), F.least(F.floor(part * n).cast("long"), n - 1))


def tile_x(lon: Column, zoom: Column) -> Column:
    """Column of the tile that holds a longitude, within the grid."""
    return _index((lon + 180.0) / 360.0, zoom)


def tile_y(lat: Column, zoom: Column) -> Column:
    """Row of the tile that holds a latitude, from the north, within the grid."""
    phi = F.radians(F.greatest(F.lit(-MAX_LAT), F.least(F.lit(MAX_LAT), lat)))
    return _index((1.0 - F.ln(F.tan(phi) + 1.0 / F.cos(phi)) / math.pi) / 2.0, zoom)


def tile_lon(x: Column, zoom: Column) -> Column:
    """Longitude of a tile's western edge."""
    return x / tiles_across(zoom) * 360.0 - 180.0


def tile_lat(y: Column, zoom: Column) -> Column:
    """Latitude of a tile's northern edge."""
    return F.degrees(F.atan(F.sinh(math.pi * (1.0 - 2.0 * y / tiles_across(zoom)))))


def tile_bounds(x: Column, y: Column, zoom: Column) -> dict[str, Column]:
    """lat_min, lon_min, lat_max, lon_max of a tile, in degrees."""
    return {"lat_min": tile_lat(y + 1, zoom), "lon_min": tile_lon(x, zoom), "lat_max": tile_lat(y, zoom), "lon_max": tile_lon(x + 1, zoom)}


def tile_metres(x: Column, y: Column, zoom: Column) -> dict[str, Column]:
    """left, bottom, right, top of a tile in web Mercator metres, and px, the size of one of its 256 pixels."""
    half = math.pi * RADIUS
    size = 2.0 * half / tiles_across(zoom)
    return {"left_m": x * size - half, "bottom_m": half - (y + 1) * size, "right_m": (x + 1) * size - half, "top_m": half - y * size, "px": size / 256.0}


def mercator(lon: Column, lat: Column) -> dict[str, Column]:
    """x_m, y_m in web Mercator metres."""
    return {"x_m": F.radians(lon) * RADIUS, "y_m": F.ln(F.tan(math.pi / 4.0 + F.radians(lat) / 2.0)) * RADIUS}


def parent(x: Column, levels: Column) -> Column:
    """Index of the ancestor ``levels`` zooms up."""
    return F.floor(x / F.pow(F.lit(2.0), levels)).cast("long")


def box_around(lon: Column, lat: Column, width_km: Column, height_km: Column) -> dict[str, Column]:
    """west, south, east, north of a box of given kilometres around a centre."""
    dy, dx = height_km / (2.0 * KM_PER_DEGREE), width_km / (2.0 * KM_PER_DEGREE * F.cos(F.radians(lat)))
    return {"west": lon - dx, "south": lat - dy, "east": lon + dx, "north": lat + dy}


def middle(west: Column, south: Column, east: Column, north: Column) -> dict[str, Column]:
    """lon, lat of the middle of a box."""
    return {"lon": (west + east) / 2.0, "lat": (south + north) / 2.0}


def within(inner: tuple[Column, Column, Column, Column], outer: tuple[Column, Column, Column, Column]) -> Column:
    """Whether a box (west, south, east, north) lies in another, edges included; true if the other has none."""
    (w, s, e, n), (ow, os, oe, on) = inner, outer
    return F.coalesce((w >= ow) & (s >= os) & (e <= oe) & (n <= on), F.lit(True))


def may_overlap(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Whether two boxes overlap, touching edges included; true where bounds are unknown, so that nothing is lost."""
    return F.coalesce((a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1]), F.lit(True))


def pixel(lon: Column, lat: Column, west: Column, south: Column, east: Column, north: Column, size: int = 256) -> dict[str, Column]:
    """px, py of a point in a tile's image, linear in degrees; (0, 0) where the bounds have no extent."""
    flat = (east <= west) | (north <= south)
    return {"px": F.when(flat, 0.0).otherwise(F.try_divide(lon - west, east - west) * size), "py": F.when(flat, 0.0).otherwise(F.try_divide(north - lat, north - south) * size)}


def window(left: Column, bottom: Column, right: Column, top: Column, origin_x: Column, origin_y: Column, px: Column, width: Column, height: Column, margin: int = 2) -> dict[str, Column]:
    """col, row, cols, rows of the pixel window that covers bounds, widened by ``margin`` and cut at the raster."""
    col = F.greatest(F.lit(0), F.floor((left - origin_x) / px) - margin)
    row = F.greatest(F.lit(0), F.floor((origin_y - top) / px) - margin)
    last_col = F.least(width, F.ceil((right - origin_x) / px) + margin)
    last_row = F.least(height, F.ceil((origin_y - bottom) / px) + margin)
    return {"col": col, "row": row, "cols": F.greatest(F.lit(0), last_col - col), "rows": F.greatest(F.lit(0), last_row - row)}


def fixed24(degrees: Column) -> Column:
    """Degrees in units of 360 / 2**24, cut toward zero."""
    return (degrees * (2.0**24) / 360.0).cast("long")


def fixed32(degrees: Column) -> Column:
    """Degrees in units of 180 / 2**31, cut toward zero."""
    return (degrees * (2.0**31) / 180.0).cast("long")


def degrees24(units: Column) -> Column:
    return units * 360.0 / 2.0**24


def degrees32(units: Column) -> Column:
    return units * 180.0 / 2.0**31
