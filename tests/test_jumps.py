from __future__ import annotations

import itertools
import math
import random

import pytest
from helpers import miles, position, positions

from fairlead.operators.jumps import (
    conflicting_instants,
    dedupe_positions,
    drop_conflicts,
    neighbour_speeds,
    remove_gps_jumps,
    unique_positions,
)
from fairlead.params import JumpRules
from fairlead.schema import POSITION_COLUMNS

DEGREES_PER_MILE = 180 / (math.pi * 3440)


def bag(frame):
    return sorted(map(repr, (tuple(row) for row in frame.select(*POSITION_COLUMNS).collect())))


def test_conflicts_and_copies(spark):
    rows = [
        position(seconds=0),
        position(seconds=0),
        position(seconds=1, sog=2.0),
        position(seconds=1, sog=1.0),
        position(seconds=2, lat=55.0),
        position(seconds=2, lat=55.1),
        position(seconds=3, lat=0.0),
        position(seconds=3, lat=-0.0),
        position("219000002", seconds=2),
    ]
    table = positions(spark, rows)
    assert [(row.mmsi, row.timestamp.second) for row in conflicting_instants(table).collect()] == [("219000001", 2)]
    assert drop_conflicts(table).count() == 7
    assert dedupe_positions(drop_conflicts(table)).count() == 4
    unique = unique_positions(table)
    assert unique.count() == 4
    assert [row.sog for row in unique.collect() if row.timestamp.second == 1] == [1.0]


def test_one_step_equals_two(spark):
    rng = random.Random(5)
    rows = [
        position(f"21900000{rng.randrange(3)}", rng.randrange(30), 55 + rng.randrange(2) / 10, sog=rng.choice([None, 1.0, 2.0]))
        for _ in range(400)
    ]
    table = positions(spark, rows)
    assert bag(unique_positions(table)) == bag(dedupe_positions(drop_conflicts(table)))
    assert bag(unique_positions(table)) == bag(unique_positions(table.orderBy("sog").repartition(3)))


SPEEDS = (None, 50.0, 100.0, 300.0)
STRICT = {(None, 50.0), (50.0, None), (50.0, 50.0), (50.0, 100.0), (50.0, 300.0), (100.0, 50.0), (300.0, 50.0)}
LIMIT = STRICT | {(None, None), (None, 100.0), (100.0, None)}


@pytest.mark.parametrize("mode, kept", [("strict", STRICT), ("limit", LIMIT)])
def test_every_combination_of_neighbour_speeds(spark, mode, kept):
    """The middle point of up to three, an hour apart, with the given knots before and after it."""
    rows, cases = [], {}
    for number, (before, after) in enumerate(itertools.product(SPEEDS, SPEEDS)):
        mmsi = f"2190001{number:02d}"
        cases[mmsi] = (before, after)
        if before is not None:
            rows.append(position(mmsi, 0, lat=10 - before * DEGREES_PER_MILE))
        rows.append(position(mmsi, 3600, lat=10.0))
        if after is not None:
            rows.append(position(mmsi, 7200, lat=10 + after * DEGREES_PER_MILE))
    for segment in (86_400, 3600, 7000):
        left = remove_gps_jumps(positions(spark, rows), JumpRules(edge_mode=mode, segment_seconds=segment))
        assert {cases[row.mmsi] for row in left.filter("latitude = 10").collect()} == kept


def test_speeds_against_a_plain_loop(spark):
    rng = random.Random(11)
    rows = {}
    for _ in range(600):
        mmsi, second = f"21900000{rng.randrange(4)}", rng.randrange(200_000)
        rows[mmsi, second] = position(mmsi, second, 55 + rng.random(), 14 + rng.random())
    expected = {}
    for mmsi in {key[0] for key in rows}:
        track = sorted(second for name, second in rows if name == mmsi)
        for i, second in enumerate(track):
            here = rows[mmsi, second]

            def knots(j):
                if not 0 <= j < len(track):
                    return None
                there = rows[mmsi, track[j]]
                return miles(here[2], here[3], there[2], there[3]) / (abs(track[j] - second) / 3600)

            expected[mmsi, here[1]] = (knots(i - 1), knots(i + 1))
    for segment in (600, 40_000, 86_400, 10**9):
        result = neighbour_speeds(positions(spark, list(rows.values())), segment)
        found = {(r.mmsi, r.timestamp): (r.previous_speed_knots, r.next_speed_knots) for r in result.collect()}
        assert found.keys() == expected.keys()
        for key, pair in expected.items():
            for ours, theirs in zip(found[key], pair):
                assert (ours is None) == (theirs is None)
                assert ours is None or ours == pytest.approx(theirs, rel=1e-6)


def test_points_within_one_second_have_no_speed(spark):
    rows = [position(seconds=0), position(seconds=0.5, lat=56.0)]
    speeds = neighbour_speeds(positions(spark, rows)).collect()
    assert [row.next_speed_knots for row in speeds] == [None, None]


def test_unknown_mode_is_refused():
    with pytest.raises(ValueError, match="edge_mode"):
        JumpRules(edge_mode="loose")
