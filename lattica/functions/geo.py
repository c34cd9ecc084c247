"""Geography as Column arithmetic: great-circle distance, boxes and polygons."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mean radius of the Earth and kilometres of a unit.
EARTH_KM = 6371.0
KM_OF = {"km": 1.0, "miles": 1.60934, "meters": 0.001}


def is_valid(lat: Column, lng: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lng.between(-180, 180), F.lit(False))


def haversine(lat: Column, lng: Column, lat0: float, lng0: float) -> Column:
    """Kilometres to a point."""
    dlat, dlng = F.radians(lat - lat0), F.radians(lng - lng0)
    h = F.pow(F.sin(dlat / 2), 2) + math.cos(math.radians(lat0)) * F.cos(F.radians(lat)) * F.pow(F.sin(dlng / 2), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def _near(lat0: float, lng0: float, km: float) -> Column:
    """Bounding box of a circle, which parquet statistics can prune: degrees of longitude grow towards the poles and wrap at 180."""
    dlat = math.degrees(km / EARTH_KM) * 1.000001
    inside = F.col("lat").between(lat0 - dlat, lat0 + dlat)
    if abs(lat0) + dlat >= 90:
        return inside
    dlng = math.degrees(math.asin(min(1.0, math.sin(math.radians(dlat)) / math.cos(math.radians(lat0))))) * 1.000001
    low, high = lng0 - dlng, lng0 + dlng
    across = F.col("lng").between(low, high)
    if low < -180:
        across = across | (F.col("lng") >= low + 360)
    if high > 180:
        across = across | (F.col("lng") <= high - 360)
    return inside & across


def radius_search(points: DataFrame, lat: float, lng: float, radius: float, unit: str = "km") -> DataFrame:
    """Points within a radius, nearest first, with ``distance`` in the unit."""
    if not (-90 <= lat <= 90 and -180 <= lng <= 180):
        raise ValueError("invalid coordinate")
    km = radius * KM_OF[unit]
    found = points.where(_near(lat, lng, km)).withColumn("_km", haversine(F.col("lat"), F.col("lng"), lat, lng)).where(F.col("_km") <= km)
    return found.withColumn("distance", F.col("_km") / KM_OF[unit]).drop("_km").orderBy("distance", "id")


def nearest(points: DataFrame, lat: float, lng: float, k: int) -> DataFrame:
    return points.withColumn("distance", haversine(F.col("lat"), F.col("lng"), lat, lng)).orderBy("distance", "id").limit(k)


def in_box(points: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    if south > north or west > east:
        raise ValueError("invalid box")
    return points.where(F.col("lat").between(south, north) & F.col("lng").between(west, east))


def in_polygon(points: DataFrame, polygon: Sequence[tuple[float, float]]) -> DataFrame:
    """Points inside a polygon of (lat, lng) by the even-odd rule, unrolled; its box is asked first."""
    if len(polygon) < 3:
        raise ValueError("a polygon has three points at least")
    lats, lngs = [p[0] for p in polygon], [p[1] for p in polygon]
    crossings = F.lit(0)
    for (a_lat, a_lng), (b_lat, b_lng) in zip(polygon, [polygon[-1], *polygon[:-1]]):
        if a_lat == b_lat:
            continue
        spans = (F.lit(a_lat) > F.col("lat")) != (F.lit(b_lat) > F.col("lat"))
        crossing = (b_lng - a_lng) * (F.col("lat") - a_lat) / (b_lat - a_lat) + a_lng
        crossings = crossings + (spans & (F.col("lng") < crossing)).cast("int")
    return in_box(points, min(lats), min(lngs), max(lats), max(lngs)).where(crossings % 2 == 1)
