"""Distances, boxes and geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import METRES_PER_DEGREE, MISSING

MATCH_SIGMA = 20.0  # metres, of the observation model


def col(c: Column | str | float) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def haversine(lon1, lat1, lon2, lat2, radius_km: float = 6378.137) -> Column:
    """Great-circle metres; radius 6378.137, 6367 or 6371 km by use."""
    lon1, lat1, lon2, lat2 = map(col, (lon1, lat1, lon2, lat2))
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return 2 * radius_km * 1000 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def haversine_atan2(lon1, lat1, lon2, lat2, radius_km: float = 6371.0) -> Column:
    """The arc-tangent form of the same, metres."""
    lon1, lat1, lon2, lat2 = map(col, (lon1, lat1, lon2, lat2))
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return 2 * radius_km * 1000 * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(0.0), 1 - h)))


def equirectangular(dlon, dlat, lat) -> Column:
    """Flat metres of a difference in degrees, longitudes shrunk by the cosine of the latitude (in radians)."""
    dlon, dlat, lat = map(col, (dlon, dlat, lat))
    return METRES_PER_DEGREE * F.sqrt(F.pow(dlon * F.cos(F.radians(lat)), 2) + F.pow(dlat, 2))


def euclid(dx, dy) -> Column:
    return F.hypot(col(dx), col(dy))


def euclid_metres(dx, dy) -> Column:
    return euclid(dx, dy) * METRES_PER_DEGREE


def line_distance(x, y, x1, y1, x2, y2) -> Column:
    """From a point to the infinite line through two points; null where they coincide."""
    x, y, x1, y1, x2, y2 = map(col, (x, y, x1, y1, x2, y2))
    a, b = y2 - y1, x1 - x2
    norm = F.sqrt(a * a + b * b)
    return F.when(norm > 0, F.abs(a * (x - x1) + b * (y - y1)) / norm)


def segment_distance(a: Column, b: Column, c: Column) -> Column:
    """From a point to a segment of length c whose ends are a and b away: an end's distance where the angle there is
    obtuse, else the height by Heron's formula."""
    s = (a + b + c) / 2
    area = F.sqrt(s * F.abs(s - a) * F.abs(s - b) * F.abs(s - c))
    return F.when(a * a > b * b + c * c, b).when(b * b > a * a + c * c, a).when(c > 0, 2 * area / c).otherwise(a)


def matched_node(a: Column, b: Column, c: Column, start, end) -> Column:
    """The end of the segment that the nearest place is, null where it lies between the ends."""
    return F.when(a * a > b * b + c * c, col(end)).when(b * b > a * a + c * c, col(start))


def observation(distance) -> Column:
    """Gaussian density of a matching distance in metres."""
    d = col(distance)
    return F.exp(-d * d / (2 * MATCH_SIGMA**2)) / F.lit(math.sqrt(2 * math.pi) * MATCH_SIGMA)


def in_box(lon, lat, box: tuple[float, float, float, float]) -> Column:
    """Inclusive point in box (min_lon, max_lon, min_lat, max_lat)."""
    return col(lon).between(box[0], box[1]) & col(lat).between(box[2], box[3])


def in_contact(lon1, lat1, lon2, lat2, delta: float) -> Column:
    """Both differences at most delta degrees."""
    return (F.abs(col(lon1) - col(lon2)) <= delta) & (F.abs(col(lat1) - col(lat2)) <= delta)


def present(lon="lon", lat="lat") -> Column:
    """Neither null nor the missing mark (within 1e-6) on either axis."""
    return F.coalesce((F.abs(col(lon) - MISSING) > 1e-6) & (F.abs(col(lat) - MISSING) > 1e-6), F.lit(False))


def boxes_meet(a: str, b: str, grow: float = 0.0) -> Column:
    """Inclusive overlap of two boxes held in columns <prefix>min_lon, ..., the first grown by ``grow``."""
    c = F.col
    return (
        (c(f"{a}min_lon") - grow <= c(f"{b}max_lon")) & (c(f"{a}max_lon") + grow >= c(f"{b}min_lon"))
        & (c(f"{a}min_lat") - grow <= c(f"{b}max_lat")) & (c(f"{a}max_lat") + grow >= c(f"{b}min_lat"))
    )


def box_measures(p: str = "") -> dict[str, Column]:
    """width, height, area and centre of a box."""
    w, h = F.col(f"{p}max_lon") - F.col(f"{p}min_lon"), F.col(f"{p}max_lat") - F.col(f"{p}min_lat")
    return {"width": w, "height": h, "area": w * h, "mid_lon": F.col(f"{p}min_lon") + w / 2, "mid_lat": F.col(f"{p}min_lat") + h / 2}
