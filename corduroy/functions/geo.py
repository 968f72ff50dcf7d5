"""Geometry as column expressions: distances, projections, polylines as arrays of points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM, KM_PER_DEGREE = 6371.0, 111.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def planar_m(lat: Column, lon: Column, lat0: float = -10.0) -> tuple[Column, Column]:
    """Equirectangular x and y in metres around lat0."""
    return F.radians(lon) * F.cos(F.radians(F.lit(lat0))) * EARTH_KM * 1000, F.radians(lat) * EARTH_KM * 1000


def local_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Flat distance with longitudes shortened by the latitude, at 111 km a degree."""
    return F.hypot(lat1 - lat2, (lon1 - lon2) * F.cos(F.radians(lat1))) * KM_PER_DEGREE


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """box: smallest and largest latitude, smallest and largest longitude, inclusive."""
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


def valid_place(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether both coordinates are there and in the box."""
    return F.coalesce(in_box(lat, lon, box), F.lit(False))


def edge_place(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column]:
    """(t, distance) of a point against an edge: t from 0 to 1 is the nearest place along it."""
    dx, dy = x1 - x0, y1 - y0
    along = F.try_divide((px - x0) * dx + (py - y0) * dy, F.nullif(dx * dx + dy * dy, F.lit(0.0)))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(along, F.lit(0.0))))
    return t, F.hypot(px - (x0 + t * dx), py - (y0 + t * dy))


def path_length(coords: Column) -> Column:
    """Length of an array of structs (x, y)."""
    n = F.size(coords)
    steps = F.zip_with(F.slice(coords, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(coords, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda t, s: t + s)


def sinuosity(coords: Column) -> Column:
    """Path length over the straight distance between the ends; null for a closed path."""
    a, b = F.element_at(coords, 1), F.element_at(coords, -1)
    return F.try_divide(path_length(coords), F.nullif(F.hypot(b["x"] - a["x"], b["y"] - a["y"]), F.lit(0.0)))


def round_coords(coords: Column, digits: int = 5) -> Column:
    """An array of [lon, lat] arrays with rounded numbers."""
    return F.transform(coords, lambda p: F.transform(p, lambda x: F.round(x, digits)))


def point_at(coords: Column, share: Column) -> Column:
    """The vertex at a share (0 to 1) of the way along an array, by index."""
    return F.element_at(coords, (F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)) * (F.size(coords) - 1)) + 1).cast("int"))
