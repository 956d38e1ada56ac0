"""Cutting positions to a circle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.functions.geo import circle_box, haversine_nm
from fairlead.params import Circle


def inside(circle: Circle) -> Column:
    """Predicate on ``latitude`` and ``longitude``: in the circle, border included.

    The box comes first: it is cheap, decides most rows, and its ranges reach the Parquet scan.
    """
    latitude, longitude = F.col("latitude"), F.col("longitude")
    box = circle_box(circle.latitude, circle.longitude, circle.radius_nm)
    distance = haversine_nm(latitude, longitude, F.lit(circle.latitude), F.lit(circle.longitude))
    return box.contains(latitude, longitude) & (distance <= F.lit(circle.radius_nm))


def within_area(positions: DataFrame, circle: Circle = Circle()) -> DataFrame:
    """The positions inside the circle."""
    return positions.filter(inside(circle))
