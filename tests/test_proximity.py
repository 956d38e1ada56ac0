from __future__ import annotations

import hashlib
import random

import pytest
from helpers import START, at, miles, position, positions

from pyspark.sql import Observation

from fairlead.functions.geo import latitude_reach
from fairlead.operators import proximity
from fairlead.operators.proximity import (
    closest_approach,
    crowded_cells,
    find_candidates,
    home_cells,
    proximity_pairs,
    reached_cells,
)
from fairlead.params import ProximityRules
from fairlead.sources.tables import Staging


def brute_force(rows, rules=ProximityRules()):
    """Every pair of rows, by a double loop."""
    found = []
    for a in rows:
        for b in rows:
            if a[0] < b[0]:
                apart = abs(int((a[1] - START).total_seconds() // 1) - int((b[1] - START).total_seconds() // 1))
                if apart <= rules.gap_seconds and miles(a[2], a[3], b[2], b[3]) <= rules.distance_nm:
                    found.append((a[0], b[0], a[1], b[1]))
    return sorted(found)


def pairs(frame):
    return sorted((r.mmsi_1, r.mmsi_2, r.timestamp_1, r.timestamp_2) for r in frame.collect())


def cloud(seed, lat, lon, size=0.004, number=150):
    """Random reports around a place, several vessels, within five minutes."""
    rng, rows = random.Random(seed), {}
    for _ in range(number):
        mmsi, second = f"21900000{rng.randrange(5)}", rng.randrange(300)
        y = max(-90.0, min(90.0, lat + rng.uniform(-size, size)))
        x = (lon + rng.uniform(-size, size) * (30 if abs(lat) > 80 else 1) + 540) % 360 - 180
        rows[mmsi, second] = position(mmsi, second, y, x)
    return list(rows.values())


PLACES = [(55.2, 14.2), (-33.9, -70.6), (0.0, 0.0), (0.001, 180.0), (-45.0, -180.0), (89.9995, 20.0), (-90.0, 0.0), (80.5, 179.999)]


@pytest.mark.parametrize("lat, lon", PLACES)
def test_equals_brute_force_everywhere(spark, lat, lon):
    rows = cloud(1, lat, lon)
    expected = brute_force(rows)
    assert expected
    table = positions(spark, rows)
    assert pairs(proximity_pairs(table)) == expected


@pytest.mark.parametrize(
    "shape",
    [
        dict(split_rows=1),
        dict(split_rows=7),
        dict(cell_degrees=0.01, bucket_seconds=60),
        dict(cell_degrees=0.0009, bucket_seconds=7),
        dict(cell_degrees=90.0, bucket_seconds=100_000),
        dict(gap_seconds=0),
        dict(distance_nm=0.3, gap_seconds=200),
    ],
)
def test_cells_and_splitting_change_nothing(spark, shape):
    rules, rows = ProximityRules(**shape), cloud(2, 55.2, 14.2)
    assert pairs(proximity_pairs(positions(spark, rows), rules)) == brute_force(rows, rules)


def test_one_cell_holding_everything_is_divided(spark):
    rows = [position(f"2190{n:05d}", n % 50, 55.2 + n * 1e-7, 14.2) for n in range(120)]
    table, rules = positions(spark, rows), ProximityRules(split_rows=10)
    parts = {(row.early_parts, row.late_parts) for row in crowded_cells(table, rules).collect()}
    assert parts == {(12, 12)}
    assert pairs(proximity_pairs(table, rules)) == brute_force(rows)
    assert proximity_pairs(table, rules).count() == 120 * 119 // 2


def test_a_quiet_cell_beside_a_crowded_one_is_divided_on_its_late_side(spark):
    """Few reports lie in the cell, many next to it look into it: the few are repeated, the many are dealt."""
    height = 4 * latitude_reach(ProximityRules().distance_nm)
    edge = 9000 * height
    rows = [position(f"2190{n:05d}", n % 50, edge + 1e-5, 14.2) for n in range(100)]
    rows += [position(f"2191{n:05d}", n % 50, edge - 1e-5, 14.2) for n in range(4)]
    table, rules, seen = positions(spark, rows), ProximityRules(split_rows=10), Observation("visits")
    parts = {(row.early_parts, row.late_parts) for row in crowded_cells(table, rules, seen).collect()}
    assert parts == {(1, 11), (10, 11)}
    assert seen.get["visits"] == sum(len(row) > 0 for row in reached_cells(table, rules).collect())
    for stored in (None, Staging(spark).keep(crowded_cells(table, rules), "crowded")):
        assert pairs(proximity_pairs(table, rules, stored)) == brute_force(rows)


@pytest.mark.parametrize("unsalted, factor", [(65_536, 1), (60, 16)])
def test_only_cells_of_very_many_reports_are_salted(spark, monkeypatch, unsalted, factor):
    """One cell of 100 reports, one of 20; both are divided, their pairs stay."""
    monkeypatch.setattr(proximity, "_UNSALTED_ROWS", unsalted)
    rows = [position(f"2190{n:05d}", n % 50, 55.2 + n * 1e-7, 14.2) for n in range(100)]
    rows += [position(f"2191{n:05d}", n % 50, 55.9 + n * 1e-7, 14.2) for n in range(20)]
    table, rules = positions(spark, rows), ProximityRules(split_rows=10)
    crowded = Staging(spark).keep(crowded_cells(table, rules), "crowded")
    assert crowded.count() == 2
    assert pairs(proximity_pairs(table, rules, crowded)) == brute_force(rows)
    exploded = []
    monkeypatch.setattr(type(crowded), "hint", lambda frame, *_: exploded.append(frame) or frame)
    proximity._divide(home_cells(table, rules), crowded, True, rules.split_rows, *proximity._PART)
    assert exploded[0].count() == factor + 1


def test_time_gap_is_closed(spark):
    for gap, met in ((60, 1), (61, 0)):
        for start in range(0, 120, 17):
            rows = [position("219000001", start), position("219000002", start + gap)]
            assert proximity_pairs(positions(spark, rows)).count() == met


def test_same_vessel_is_no_pair_and_order_is_by_text(spark):
    rows = [position("219000001", 0), position("219000001", 5), position("1000", 3)]
    assert pairs(proximity_pairs(positions(spark, rows))) == [
        ("1000", "219000001", at(3), at(0)),
        ("1000", "219000001", at(3), at(5)),
    ]


def test_closest_approach(spark):
    rows = [
        position("219000001", 0, 55.0),
        position("219000002", 10, 55.0004),
        # A second meeting, closer, with an exact tie: the earlier time wins.
        position("219000001", 1000, 55.0),
        position("219000002", 1001, 55.0001),
        position("219000001", 1002, 55.0),
        # Another pair.
        position("219000003", 5000, 20.0),
        position("219000004", 5000, 20.0),
    ]
    found = {(row.mmsi_1, row.mmsi_2): row for row in find_candidates(positions(spark, rows)).collect()}
    assert set(found) == {("219000001", "219000002"), ("219000003", "219000004")}
    first = found["219000001", "219000002"]
    assert first.collision_time == at(1000)  # (1000 + 1001) / 2, cut to the second
    assert first.collision_latitude == (55.0 + 55.0001) / 2
    assert first.minimum_distance_nm == pytest.approx(miles(55.0, 14.0, 55.0001, 14.0))
    assert (first.name_1, first.name_2) == ("N001", "N002")
    text = f"219000001|219000002|{at(1000)}"
    assert first.candidate_id == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("seed, still", [(21, False), (22, True)])
def test_short_way_equals_the_list_of_all_pairs(spark, seed, still):
    """Also where vessels lie still, so that many report pairs share the least distance."""
    rows = cloud(seed, 55.2, 14.2, size=0.0008, number=400)
    if still:
        rows = [position(row[0], (row[1] - START).total_seconds(), 55.2 + int(row[0][-1]) * 1e-4) for row in rows]
    table = positions(spark, rows)
    listed = closest_approach(proximity_pairs(table))
    assert listed.count() == 10
    for rules in (ProximityRules(), ProximityRules(split_rows=3), ProximityRules(cell_degrees=0.01, bucket_seconds=60)):
        assert sorted(find_candidates(table, rules).collect()) == sorted(listed.collect())


def test_published_candidate(spark):
    rows = [
        position("219021240", 1649, 55.223067, 14.24373, name="KARIN HOEJ"),
        position("232018267", 1678, 55.223092, 14.243683, name="MV SCOT CARRIER"),
    ]
    row = find_candidates(positions(spark, rows)).first()
    assert str(row.collision_time) == "2021-12-13 02:27:43"
    assert row.candidate_id == "0389973fd3f46f26aac71fa450c5c942864b81d7e7a1ebf0a6a9596bae51cf35"
    assert row.minimum_distance_nm == pytest.approx(0.002200806421116268, abs=1e-12)
    assert row.collision_latitude == pytest.approx(55.2230795, abs=1e-12)
    assert row.collision_longitude == pytest.approx(14.2437065, abs=1e-12)


def test_result_does_not_depend_on_the_plan(spark):
    table = positions(spark, cloud(9, 55.2, 14.2))
    expected = sorted(find_candidates(table).collect())
    settings = [
        {"spark.sql.shuffle.partitions": "1"},
        {"spark.sql.shuffle.partitions": "64"},
        {"spark.sql.autoBroadcastJoinThreshold": "-1"},
        {"spark.sql.session.timeZone": "Asia/Kolkata"},
        {"spark.sql.adaptive.enabled": "false"},
    ]
    for setting in settings:
        before = {key: spark.conf.get(key) for key in setting}
        try:
            for key, value in setting.items():
                spark.conf.set(key, value)
            assert sorted(find_candidates(table.repartition(5)).collect()) == expected
        finally:
            for key, value in before.items():
                spark.conf.set(key, value)


def test_home_cell_wraps_at_the_date_line(spark):
    rows = [position(lon=180.0), position(lon=-180.0)]
    assert len({row.lon_cell for row in home_cells(positions(spark, rows)).collect()}) == 1


@pytest.mark.parametrize("wrong", [dict(distance_nm=0), dict(gap_seconds=-1), dict(cell_degrees=-1), dict(split_rows=0)])
def test_bad_limits_are_refused(wrong):
    with pytest.raises(ValueError):
        ProximityRules(**wrong)


def test_closest_approach_takes_repeated_pairs(spark):
    table = positions(spark, [position("219000001", 0), position("219000002", 0)])
    once = proximity_pairs(table)
    assert closest_approach(once.union(once)).collect() == closest_approach(once).collect()
