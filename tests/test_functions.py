from __future__ import annotations

import math
import random

import pytest
from helpers import miles
from pyspark.sql import functions as F

from fairlead.functions.clock import epoch_seconds, from_epoch, parse_report_time, time_text
from fairlead.functions.geo import bounding_box, circle_box, haversine_metres, haversine_nm, longitude_reach
from fairlead.functions.identity import ALLOCATED_MIDS, mmsi_rejection, mmsi_usable


def test_allocated_codes():
    assert len(ALLOCATED_MIDS) == len(set(ALLOCATED_MIDS)) == 292
    assert {"201", "219", "555", "666", "775"} <= set(ALLOCATED_MIDS)
    assert not {"123", "217", "223", "260", "658", "673", "715", "999"} & set(ALLOCATED_MIDS)


@pytest.mark.parametrize(
    "mmsi, reason",
    [
        ("219000001", None),
        ("21900000", "format"),
        ("2190000011", "format"),
        ("21900000a", "format"),
        (" 219000001", "format"),
        ("", "format"),
        (None, "format"),
        ("123456789", "blocked"),
        ("555555555", "repeated"),
        ("666666666", "repeated"),
        ("999000001", "unallocated"),
        ("217000001", "unallocated"),
    ],
)
def test_mmsi_rules(spark, mmsi, reason):
    row = spark.createDataFrame([(mmsi,)], "id string").select(mmsi_rejection("id"), mmsi_usable("id")).first()
    assert row[0] == reason
    assert bool(row[1]) == (reason is None)


def test_times_in_three_spellings(spark):
    texts = {
        "13/12/2021 02:27:43": "2021-12-13 02:27:43",
        "2021-12-13 02:27:43": "2021-12-13 02:27:43",
        "2021-12-13T02:27:43": "2021-12-13 02:27:43",
        "  13/12/2021 02:27:43 ": "2021-12-13 02:27:43",
        # Skipped by the session zone's clock change: must survive.
        "2021-03-14 02:30:00": "2021-03-14 02:30:00",
        "1/12/2021 00:00:00": None,
        "31/02/2021 00:00:00": None,
        "2021-12-13 02:27:43Z": None,
        "2021-12-13": None,
        "junk": None,
        "": None,
    }
    frame = spark.createDataFrame([(text,) for text in texts], "t string")
    parsed = frame.select("t", parse_report_time(F.col("t")).alias("p"))
    assert parsed.schema["p"].dataType.simpleString() == "timestamp_ntz"
    assert {row.t: row.s for row in parsed.select("t", time_text(F.col("p")).alias("s")).collect()} == texts


def test_epoch_round_trip(spark):
    seconds = [0, -1, 1_639_362_463, 1_615_689_000]
    frame = spark.createDataFrame([(s,) for s in seconds], "s long")
    assert [row[0] for row in frame.select(epoch_seconds(from_epoch(F.col("s")))).collect()] == seconds


def _evaluate(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_published_distances(spark):
    def metres(*places):
        return haversine_metres(*(F.lit(place) for place in places))

    first, second, third = _evaluate(
        spark,
        metres(55.235113, 14.262408, 55.223067, 14.24373),
        metres(55.235347, 14.291273, 55.223112, 14.244242),
        metres(55.235113, 14.262408, 55.235347, 14.291273),
    )
    assert first == pytest.approx(1787.9973641125039, abs=1e-6)
    assert second == pytest.approx(3278.000445808259, abs=1e-6)
    assert third == pytest.approx(1830.3155288873609, abs=1e-6)
    nearest = haversine_nm(F.lit(55.223067), F.lit(14.24373), F.lit(55.223092), F.lit(14.243683))
    assert _evaluate(spark, nearest)[0] == pytest.approx(0.002200806421116268, abs=1e-12)


def test_antipodes_have_a_distance(spark):
    far = haversine_nm(F.lit(12.3), F.lit(45.6), F.lit(-12.3), F.lit(-134.4))
    assert _evaluate(spark, far)[0] == pytest.approx(math.pi * 3440)


def test_published_bounding_box():
    south, north, west, east = bounding_box(55.225, 14.245, 50.0)
    assert (south, north) == (55.225 - 50 / 60, 55.225 + 50 / 60)
    assert (east - west) / 2 == pytest.approx(1.4611, abs=1e-4)


@pytest.mark.parametrize(
    "lat, lon, radius", [(55.225, 14.245, 50), (0, 179.9, 30), (-70, -179.99, 400), (89, 10, 100), (60, 0, 2000)]
)
def test_circle_box_contains_the_circle(spark, lat, lon, radius):
    box, rng = circle_box(lat, lon, radius), random.Random(7)
    rows = []
    for _ in range(400):
        # A point at a random bearing, at most the radius away.
        bearing, arc = rng.uniform(0, 2 * math.pi), radius * rng.choice([1, rng.random()]) / 3440
        phi = math.radians(lat)
        phi2 = math.asin(math.sin(phi) * math.cos(arc) + math.cos(phi) * math.sin(arc) * math.cos(bearing))
        dlam = math.atan2(
            math.sin(bearing) * math.sin(arc) * math.cos(phi), math.cos(arc) - math.sin(phi) * math.sin(phi2)
        )
        rows.append((math.degrees(phi2), (lon + math.degrees(dlam) + 540) % 360 - 180))
    frame = spark.createDataFrame(rows, "lat double, lon double")
    assert frame.filter(~box.contains(F.col("lat"), F.col("lon"))).count() == 0


def test_longitude_reach_is_wide_enough(spark):
    rng = random.Random(3)
    rows = [(rng.uniform(-89.999, 89.999),) for _ in range(200)]
    frame = spark.createDataFrame(rows, "lat double").select("lat", longitude_reach(F.col("lat"), 0.05).alias("reach"))
    for row in frame.collect():
        if row.reach < 180:
            assert miles(row.lat, 0, row.lat, row.reach * 1.0001) > 0.05 * 0.999


def test_an_empty_list_switches_its_rule_off(spark):
    rows = spark.createDataFrame([("999000001",), ("123456789",), ("219000001",), ("5555",)], "mmsi string")
    found = {r.mmsi: r.why for r in rows.select("mmsi", mmsi_rejection("mmsi", (), ()).alias("why")).collect()}
    assert found == {"999000001": None, "123456789": None, "219000001": None, "5555": "format"}
    assert rows.filter(mmsi_usable("mmsi", None, None)).count() == 3
