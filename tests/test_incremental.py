"""A growing position table: updates rewrite the changed days and their borders, and equal a run from scratch."""

from __future__ import annotations

import random

import pytest
from helpers import position, positions

from fairlead.params import JumpRules, ProximityRules, Rules
from fairlead.plans import incremental
from fairlead.plans.incremental import Store
from fairlead.plans.pipeline import stage_candidates, stage_tracks
from fairlead.schema import CANDIDATE_COLUMNS, POSITION_COLUMNS
from fairlead.sources.tables import Staging, merge_positions, read_positions, write_positions

DAY = 86_400


def sail(seed, day, vessels=6, rows=12):
    """Reports of some vessels near each other through a day, some just before and after midnight, a few jumps."""
    draw = random.Random(seed)
    midnight = (day - 1) * DAY + 79_200  # The helpers' time zero is two in the morning.
    times = [midnight + s for s in (5, 30)] + [midnight + DAY - s for s in (40, 10)]
    out = []
    for v in range(vessels):
        for s in {*times, *(midnight + draw.randrange(DAY) // 60 * 60 + draw.randrange(30) for _ in range(rows))}:
            jump = 1.5 if draw.random() < 0.05 else 0.0
            out.append(position(f"21900000{v}", s, 55.2 + draw.random() * 0.0008 + jump, 14.2 + draw.random() * 0.0008))
    return out


def rows_of(table, columns):
    return sorted(map(tuple, table.select(*columns).collect()))


def same_as_from_scratch(spark, path, store, rules):
    staging = Staging(spark)
    tracks = stage_tracks(read_positions(spark, path), staging, rules)
    wanted = stage_candidates(tracks, staging, rules)
    found = store.encounters(staging)
    assert rows_of(found.tracks, POSITION_COLUMNS) == rows_of(tracks, POSITION_COLUMNS)
    assert rows_of(found.candidates, CANDIDATE_COLUMNS) == rows_of(wanted, CANDIDATE_COLUMNS)
    return wanted.count()


ENCOUNTERS = Rules(proximity=ProximityRules(per="encounter", encounter_gap_seconds=7200), jumps=JumpRules(edge_mode="limit"))


@pytest.mark.parametrize("rules, days", [(Rules(), 10), (ENCOUNTERS, 3)])
def test_adding_a_day_rewrites_at_most_three(spark, tmp_path, rules, days):
    path, folder = str(tmp_path / "positions"), str(tmp_path / "store")
    for day in range(days):
        write_positions(positions(spark, sail(day, day)), path, batch=f"d{day}")
    store = Store(spark, path, folder, rules)
    store.update()
    assert same_as_from_scratch(spark, path, store, rules) > 0
    store.update()
    assert store.redone == {"ends": [], "tracks": [], "slots": [], "candidates": []}
    merge_positions(spark, path)
    write_positions(positions(spark, sail(77, days)), path, batch="new")
    store = Store(spark, path, folder, rules)
    store.update()
    last = [f"2021-12-{13 + days - back}" for back in (2, 1, 0)]
    assert store.redone["ends"] == last[2:] and store.redone["tracks"] == last[1:] and store.redone["slots"] == last
    same_as_from_scratch(spark, path, store, rules)


def test_late_reports_of_a_day_change_its_neighbours(spark, tmp_path):
    """Vessels are silent for days; reports that come late, conflicts among them, change fixes on the days before and after."""
    path, rules = str(tmp_path / "positions"), Rules()
    for day in (0, 4):
        write_positions(positions(spark, sail(day, day)), path, batch=f"d{day}")
    store = Store(spark, path, str(tmp_path / "store"), rules)
    store.update()
    write_positions(positions(spark, sail(2, 2, vessels=3)), path, batch="late")
    store.update()
    assert store.redone["tracks"] == ["2021-12-13", "2021-12-15", "2021-12-17"]
    same_as_from_scratch(spark, path, store, rules)
    # The same reports at another place: conflicts, which remove a whole day of these vessels again.
    again = [tuple(v + 0.01 if i == 2 else v for i, v in enumerate(row)) for row in sail(2, 2, vessels=3)]
    write_positions(positions(spark, again), path, batch="conflicts")
    store.update()
    assert store.redone["tracks"] == ["2021-12-13", "2021-12-15", "2021-12-17"]
    same_as_from_scratch(spark, path, store, rules)


def test_an_update_of_the_tracks_takes_few_jobs_and_files(spark, tmp_path, monkeypatch):
    """The days beside changed ones are looked for once, and a day's ends, a row a vessel, are one file."""
    path, asked = str(tmp_path / "positions"), []
    for day in (0, 4):
        write_positions(positions(spark, sail(day, day)), path, batch=f"d{day}")
    store = Store(spark, path, str(tmp_path / "store"))
    days = incremental._days
    monkeypatch.setattr(incremental, "_days", lambda frame: asked.append(1) or days(frame))
    staging = Staging(spark)
    store._update_tracks(staging)
    assert len(asked) == 1
    write_positions(positions(spark, sail(2, 2, vessels=3)), path, batch="late")
    store._update_tracks(staging)
    assert len(asked) == 2 and store.redone["tracks"] == ["2021-12-13", "2021-12-15", "2021-12-17"]
    files = [str(f.parent) for f in (tmp_path / "store" / "ends").rglob("*.parquet")]
    assert len(files) == len(set(files)) == 3


def test_an_update_that_broke_off_is_taken_up(spark, tmp_path, monkeypatch):
    path, rules = str(tmp_path / "positions"), Rules()
    write_positions(positions(spark, sail(0, 0)), path)
    store = Store(spark, path, str(tmp_path / "store"), rules)
    store.update()
    write_positions(positions(spark, sail(1, 1)), path)
    for table in ("ends", "slots", "candidates"):
        monkeypatch.setattr(getattr(store, table), "replace", broken)
        with pytest.raises(OSError, match="lost"):
            store.update()
        monkeypatch.undo()
    store.update()
    same_as_from_scratch(spark, path, store, rules)


def broken(*args, **options):
    raise OSError("lost")


def test_rules_that_do_not_fit_are_refused(spark, tmp_path):
    for rules in (Rules(jumps=JumpRules(segment_seconds=3600)), Rules(proximity=ProximityRules(gap_seconds=90_000))):
        with pytest.raises(ValueError, match="86400"):
            Store(spark, str(tmp_path), str(tmp_path), rules)
