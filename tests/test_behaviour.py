from __future__ import annotations

import random

import pytest
from helpers import at, candidate, candidates, miles, position, positions

from fairlead.operators.behaviour import (
    after_stats,
    before_stats,
    candidate_sides,
    pivot_sides,
    select_side,
    side_stats,
    vessel_types,
)
from fairlead.params import BehaviourRules

ONE, TWO = "219000001", "219000002"


def sides_of(spark, *rows):
    return candidate_sides(candidates(spark, list(rows) or [candidate(seconds=1000)]))


def by_side(frame):
    return {(row.candidate_id, row.vessel_side): row for row in frame.collect()}


def test_sides(spark):
    rows = sides_of(spark, candidate()).select("candidate_id", "vessel_side", "mmsi", "collision_time").collect()
    assert sorted(map(tuple, rows)) == [("c1", "1", ONE, at(600)), ("c1", "2", TWO, at(600))]


def test_window_borders(spark):
    seconds = [399, 400, 1000, 1001, 1600, 1601]
    track = positions(spark, [position(ONE, second, sog=float(second)) for second in seconds])
    before, after = (by_side(stats(sides_of(spark), track)) for stats in (before_stats, after_stats))
    assert before["c1", "1"].before_point_count == 2  # 400 and 1000
    assert before["c1", "1"].before_median_sog == 400.0
    assert after["c1", "1"].after_point_count == 2  # 1001 and 1600
    assert after["c1", "1"].after_median_sog == 1001.0
    both = by_side(side_stats(sides_of(spark), track))["c1", "1"]
    assert (both.before_point_count, both.after_point_count) == (2, 2)
    assert (both.before_median_sog, both.after_median_sog) == (400.0, 1001.0)


def test_fractions_of_a_second_count_on_the_right_side(spark):
    track = positions(spark, [position(ONE, 399.9), position(ONE, 1000.4), position(ONE, 1600.4)])
    assert before_stats(sides_of(spark), track).count() == 0
    assert by_side(after_stats(sides_of(spark), track))["c1", "1"].after_point_count == 1


def test_silent_sides(spark):
    track = positions(spark, [position(ONE, 900, sog=5.0)])
    before, after = before_stats(sides_of(spark), track), after_stats(sides_of(spark), track)
    assert list(by_side(before)) == [("c1", "1")]
    assert {key: (row.after_point_count, row.after_median_sog) for key, row in by_side(after).items()} == {
        ("c1", "1"): (0, None),
        ("c1", "2"): (0, None),
    }
    assert pivot_sides(side_stats(sides_of(spark), track)).count() == 0


def test_median_ignores_nulls_and_takes_the_lower(spark):
    track = positions(spark, [position(ONE, s, sog=v) for s, v in [(900, 1.0), (910, 2.0), (920, 3.0), (930, 4.0), (940, None)]])
    row = by_side(before_stats(sides_of(spark), track))["c1", "1"]
    assert (row.before_point_count, row.before_median_sog) == (5, 2.0)
    nothing = positions(spark, [position(ONE, 900), position(ONE, 901)])
    assert by_side(before_stats(sides_of(spark), nothing))["c1", "1"].before_median_sog is None


def test_median_is_exact_in_large_groups(spark):
    """30,001 speeds in one long window: beyond what a sketch of 10,000 values tells exactly."""
    track = spark.range(30_001).selectExpr(
        f"'{ONE}' AS mmsi", "timestampadd(SECOND, id, timestamp_ntz'2021-12-13 00:00:00') AS timestamp", "55.0D AS latitude",
        "14.0D AS longitude", "CAST(NULL AS STRING) AS navigational_status", "CAST(id AS DOUBLE) + 0.5D AS sog", "0.0D AS cog",
        "0.0D AS heading", "'N' AS name", "'Cargo' AS ship_type", "1.0D AS width", "1.0D AS length", "1.0D AS draught",
    )
    row = by_side(before_stats(sides_of(spark, candidate(seconds=23_000)), track, BehaviourRules(window_minutes=600)))["c1", "1"]
    assert (row.before_point_count, row.before_median_sog) == (30_001, 15000.5)


def test_first_last_and_metres_moved(spark):
    track = positions(spark, [position(ONE, 950, 55.02), position(ONE, 900, 55.0), position(ONE, 999, 55.01, 14.01)])
    row = by_side(before_stats(sides_of(spark), track))["c1", "1"]
    assert (row.first_latitude, row.last_latitude, row.last_longitude) == (55.0, 55.01, 14.01)
    assert row.before_moved_meters == pytest.approx(miles(55.0, 14.0, 55.01, 14.01) * 1852)


def test_slots_equal_a_plain_range_join(spark):
    rng = random.Random(4)
    track_rows = {}
    for _ in range(800):
        mmsi, second = f"21900000{rng.randrange(3)}", rng.randrange(-4000, 4000)
        track_rows[mmsi, second] = position(mmsi, second, 55 + rng.random(), sog=rng.choice([None, float(rng.randrange(20))]))
    cases = [
        candidate(f"c{n}", f"21900000{rng.randrange(3)}", f"21900000{rng.randrange(3)}", rng.randrange(-4000, 4000))
        for n in range(40)
    ]
    for minutes in (1, 10, 45):
        rules = BehaviourRules(minutes)
        sides = candidate_sides(candidates(spark, cases))
        found = by_side(side_stats(sides, positions(spark, list(track_rows.values())), rules))
        alone = by_side(after_stats(sides, positions(spark, list(track_rows.values())), rules))
        for case in cases:
            for side, mmsi in (("1", case[1]), ("2", case[2])):
                own = sorted((row[1], row) for (name, _), row in track_rows.items() if name == mmsi)
                span = minutes * 60
                early = [r for t, r in own if -span <= (t - case[5]).total_seconds() <= 0]
                late = [r for t, r in own if 0 < (t - case[5]).total_seconds() <= span]

                def median(rows):
                    speeds = sorted(row[5] for row in rows if row[5] is not None)
                    return speeds[(len(speeds) - 1) // 2] if speeds else None

                assert (alone[case[0], side].after_point_count, alone[case[0], side].after_median_sog) == (len(late), median(late))
                if not early:
                    assert (case[0], side) not in found
                    continue
                row = found[case[0], side]
                assert (row.before_point_count, row.after_point_count) == (len(early), len(late))
                assert (row.before_median_sog, row.after_median_sog) == (median(early), median(late))
                assert (row.first_latitude, row.last_latitude) == (early[0][2], early[-1][2])


def test_select_and_pivot(spark):
    track = positions(spark, [position(ONE, 900, sog=5.0), position(TWO, 900, sog=7.0)])
    stats = before_stats(sides_of(spark), track)
    second = select_side(stats, "2", "vessel_2").first()
    assert second.vessel_2_before_median_sog == 7.0
    assert "vessel_side" not in select_side(stats, "2", "vessel_2").columns
    wide = pivot_sides(stats).first()
    assert (wide.vessel_1_before_median_sog, wide.vessel_2_before_median_sog) == (5.0, 7.0)


def test_latest_known_type(spark):
    track = positions(
        spark,
        [
            position(ONE, 1, ship_type="Cargo"),
            position(ONE, 2, ship_type="Tanker"),
            position(ONE, 3, ship_type="Undefined"),
            position(ONE, 4, ship_type=None),
            position(TWO, 1, ship_type="Undefined"),
        ],
    )
    assert [tuple(row) for row in vessel_types(track).collect()] == [(ONE, "Tanker")]
