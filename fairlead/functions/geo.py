"""Distances and boxes on a spherical Earth, as column expressions and driver-side scalars."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_RADIUS_NM = 3440.0
METRES_PER_NM = 1852.0
NM_PER_DEGREE = 60.0

# Room for rounding where a box must contain a circle (degrees; a tenth of a millimetre).
_SLACK = 1e-9


def _sin_half_squared(start: Column, end: Column) -> Column:
    # A product: Spark's pow runs the slow, strict library routine.
    half = F.sin(F.radians(end - start) / 2)
    return half * half


def haversine_nm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in nautical miles."""
    across = F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * _sin_half_squared(lon1, lon2)
    chord = _sin_half_squared(lat1, lat2) + across
    # Rounding can lift antipodes above 1, where asin is undefined.
    return F.lit(2 * EARTH_RADIUS_NM) * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))


def haversine_metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine_nm(lat1, lon1, lat2, lon2) * F.lit(METRES_PER_NM)


def bounding_box(latitude: float, longitude: float, radius_nm: float) -> tuple[float, float, float, float]:
    """(min_lat, max_lat, min_lon, max_lon) at 60 NM per degree, with the centre's cosine.

    This is the published rule. It is slightly too narrow for large radii and near the poles; use
    ``circle_box`` where the box must contain the circle.
    """
    height = radius_nm / NM_PER_DEGREE
    width = height / math.cos(math.radians(latitude))
    return latitude - height, latitude + height, longitude - width, longitude + width


@dataclass(frozen=True)
class Box:
    min_latitude: float
    max_latitude: float
    min_longitude: float
    max_longitude: float

    def contains(self, latitude: Column, longitude: Column) -> Column:
        """Range comparisons on literals, which reach the Parquet scan."""
        rows = latitude.between(F.lit(self.min_latitude), F.lit(self.max_latitude))
        west, east = self.min_longitude, self.max_longitude
        if east - west >= 360:
            return rows
        if west < -180:
            return rows & ((longitude >= F.lit(west + 360)) | (longitude <= F.lit(east)))
        if east > 180:
            return rows & ((longitude >= F.lit(west)) | (longitude <= F.lit(east - 360)))
        return rows & longitude.between(F.lit(west), F.lit(east))


def circle_box(latitude: float, longitude: float, radius_nm: float) -> Box:
    """Smallest latitude/longitude box that contains the circle, also across 180 degrees and a pole."""
    angle = radius_nm / EARTH_RADIUS_NM
    height = math.degrees(angle) + _SLACK
    if abs(latitude) + height >= 90:
        width = 180.0
    else:
        width = math.degrees(math.asin(math.sin(angle) / math.cos(math.radians(latitude)))) + _SLACK
    return Box(latitude - height, latitude + height, longitude - width, longitude + width)


def longitude_reach(latitude: Column, distance_nm: float) -> Column:
    """Degrees of longitude that positions within ``distance_nm`` of one at ``latitude`` may differ by."""
    angle = distance_nm / EARTH_RADIUS_NM
    height = math.degrees(angle) + _SLACK
    sideways = F.degrees(F.asin(F.least(F.lit(math.sin(angle)) / F.cos(F.radians(latitude)), F.lit(1.0))))
    return F.when(F.abs(latitude) + F.lit(height) >= 90, F.lit(180.0)).otherwise(sideways + F.lit(_SLACK))


def latitude_reach(distance_nm: float) -> float:
    """Degrees of latitude that positions within ``distance_nm`` may differ by."""
    return math.degrees(distance_nm / EARTH_RADIUS_NM) + _SLACK
