"""Small hand-written tables for the tests."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from fairlead.schema import CANDIDATE_SCHEMA, POSITION_COLUMNS, POSITION_SCHEMA, RAW_COLUMNS, RAW_SCHEMA

START = datetime(2021, 12, 13, 2, 0, 0)


def at(seconds: float) -> datetime:
    return START + timedelta(seconds=seconds)


def position(mmsi="219000001", seconds=0.0, lat=55.0, lon=14.0, **rest) -> tuple:
    row = dict(mmsi=mmsi, timestamp=at(seconds), latitude=lat, longitude=lon, name=f"N{mmsi[-3:]}", **{}) | rest
    return tuple(row.get(name) for name in POSITION_COLUMNS)


def positions(spark, rows):
    return spark.createDataFrame(rows, POSITION_SCHEMA)


def report(**changes) -> tuple:
    row = {
        "# Timestamp": "13/12/2021 02:00:00",
        "MMSI": "219000001",
        "Latitude": "55.2",
        "Longitude": "14.2",
        "Navigational status": "Under way",
        "SOG": "10.5",
        "COG": "180",
        "Heading": "181",
        "Name": "VESSEL",
        "Ship type": "Cargo",
        "Width": "10",
        "Length": "100",
        "Draught": "5.5",
    } | changes
    return tuple(row[name] for name in RAW_COLUMNS)


def reports(spark, rows):
    return spark.createDataFrame(rows, RAW_SCHEMA)


def candidate(cid="c1", one="219000001", two="219000002", seconds=600.0, distance=0.001, **rest) -> tuple:
    row = dict(
        candidate_id=cid,
        mmsi_1=one,
        mmsi_2=two,
        name_1="ONE",
        name_2="TWO",
        collision_time=at(seconds),
        collision_latitude=55.0,
        collision_longitude=14.0,
        minimum_distance_nm=distance,
    ) | rest
    return tuple(row[name] for name in CANDIDATE_SCHEMA.names)


def candidates(spark, rows):
    return spark.createDataFrame(rows, CANDIDATE_SCHEMA)


def miles(lat1, lon1, lat2, lon2) -> float:
    """Great-circle distance by the spherical law the library does not use (chord of unit vectors)."""

    def vector(lat, lon):
        phi, lam = math.radians(lat), math.radians(lon)
        return math.cos(phi) * math.cos(lam), math.cos(phi) * math.sin(lam), math.sin(phi)

    a, b = vector(lat1, lon1), vector(lat2, lon2)
    return 2 * 3440 * math.asin(min(1.0, math.dist(a, b) / 2))
