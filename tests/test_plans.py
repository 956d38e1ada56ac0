"""The shape of the physical plans, which the results alone do not show."""

from __future__ import annotations

import glob
import os
import re

import pytest
from helpers import candidate, candidates, position, positions

from fairlead.operators.area import within_area
from fairlead.operators.behaviour import after_stats, before_stats, candidate_sides, side_stats, vessel_types
from fairlead.operators.cleaning import clean_reports
from fairlead.operators.collisions import score_candidates
from fairlead.operators.jumps import conflicting_instants, remove_gps_jumps, segment_ends, unique_positions, with_segment
from fairlead.operators.proximity import crowded_cells, nearest_slots, pinpoint
from fairlead.operators.results import trajectory_paths, trajectory_points
from fairlead.params import JumpRules
from fairlead.plans import pipeline
from fairlead.plans.pipeline import stage_tracks
from fairlead.schema import DAY
from fairlead.sources.sample import sample_reports
from fairlead.sources.tables import Staging, with_day


@pytest.fixture(scope="module", autouse=True)
def whole_text(spark):
    before = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    yield
    spark.conf.set("spark.sql.maxMetadataStringLength", before)


@pytest.fixture(scope="module")
def tables(spark):
    staging = Staging(spark)
    track = staging.keep(positions(spark, [position(seconds=s) for s in range(50)]), "tracks")
    return track, staging.keep(candidates(spark, [candidate()]), "candidates"), staging


@pytest.fixture
def no_broadcast(spark):
    """Plans as for tables too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def planned(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def executed(frame) -> str:
    """The final adaptive plan, without the initial one."""
    execution = frame._jdf.queryExecution()
    execution.toRdd().count()
    return execution.executedPlan().toString().split("== Initial Plan ==")[0]


def above(plan: str, line: str) -> list[str]:
    """The operators from ``line`` up to the next join."""
    lines = plan.split("\n")
    at, found = lines.index(line), []
    depth = re.search(r"[A-Za-z*]", line).start()
    for other in reversed(lines[:at]):
        start = re.search(r"[A-Za-z*]", other)
        if start and start.start() < depth:
            depth = start.start()
            found.append(other)
            if "Join" in other:
                break
    return found


def shuffles(plan: str) -> list[str]:
    fresh = "\n".join(line for line in plan.split("\n") if "ReusedExchange" not in line)
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", fresh)


def key(text: str) -> list[str]:
    return [re.sub(r"#\d+L?", "", part.strip()) for part in text.split(",")][:-1]


def test_cleaning_is_narrow(spark):
    plan = planned(clean_reports(sample_reports(spark, "/root/testdata/sf0.001")))
    # The one exchange spreads the single small input file; see ``sample.events``.
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") == 1
    assert "PythonUDF" not in plan


def test_area_reaches_the_scan(tables):
    plan = planned(within_area(tables[0]).select("mmsi"))
    assert "GreaterThanOrEqual(latitude" in plan and "LessThanOrEqual(longitude" in plan
    assert "ReadSchema: struct<mmsi:string,latitude:double,longitude:double>" in plan


def test_duplicates_take_one_shuffle_with_map_side_combine(tables):
    plan = planned(unique_positions(tables[0]))
    assert [key(text) for text in shuffles(plan)] == [["mmsi", "timestamp"]]
    assert "partial_min" in plan and "Join" not in plan


def test_ends_and_conflicts_are_found_by_hash_aggregation(tables):
    for frame in (segment_ends(with_segment(tables[0])), conflicting_instants(tables[0])):
        plan = planned(frame)
        assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_jump_filter_never_shuffles_a_whole_track_to_one_task(tables, no_broadcast):
    plan = executed(remove_gps_jumps(tables[0]))
    whole = [key(text) for text in shuffles(plan)]
    # By vessel alone goes only the table of segment ends; the input is shuffled once, and reused.
    assert whole.count(["mmsi"]) == 1 and whole.count(["mmsi", "timestamp"]) == 1
    assert "ReusedExchange" in plan
    widths = {",".join(key(text)): len(re.findall("draught", line)) for line in plan.split("\n") for text in shuffles(line)}
    assert widths["mmsi"] == 0


def test_meetings_are_hashed_down_before_any_sort_or_shuffle(tables, no_broadcast):
    track, _, staging = tables
    crowded = staging.keep(crowded_cells(track), "crowded")
    plan = planned(nearest_slots(track, crowded=crowded))
    keys = [key(text) for text in shuffles(plan)]
    assert keys.count(["time_bucket", "lat_cell", "lon_cell", "early_part", "late_part"]) == 2
    assert keys.count(["mmsi_1", "mmsi_2", "slot"]) == keys.count(["mmsi_1", "mmsi_2"]) == 1
    assert "HashAggregate(keys=[mmsi_1" in plan and "partial_min(distance_nm" in plan and "Window" not in plan
    # Names do not travel through the join.
    assert "name" not in re.sub(r"\S*fairlead\S*|tracks", "", plan)


def test_no_exchange_gathers_a_crowded_cell(tables, no_broadcast):
    """Reports that lie in no crowded cell are shuffled once, by cell and part; the others first by cell and salt."""
    track, _, staging = tables
    plan = planned(nearest_slots(track, crowded=staging.keep(crowded_cells(track), "crowded_again")))
    by_cell = [key(text) for text in shuffles(plan) if "time_bucket" in text]
    assert by_cell.count(["time_bucket", "lat_cell", "lon_cell", "early_part", "late_part"]) == 2
    assert by_cell.count(["time_bucket", "lat_cell", "lon_cell", "salt"]) == len(by_cell) - 2 > 0
    # Only the bitmap is broadcast; its rows are bounded.
    assert set(re.findall(r"BroadcastHashJoin \[(\w+?)#", plan)) == {"word"}


def test_crowded_cells_are_never_sent_through_the_driver(spark, tables):
    """Spark knows the size of the stored cells, not that their rows are repeated for the salts."""
    track, _, staging = tables
    crowded = staging.keep(crowded_cells(track), "crowded_many")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100g")
    try:
        plan = planned(nearest_slots(track, crowded=crowded))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert set(re.findall(r"BroadcastHashJoin \[(\w+?)#", plan)) == {"word"}
    assert len(re.findall(r"SortMergeJoin \[time_bucket#\d+L, lat_cell#\d+L, lon_cell#\d+L, salt", plan)) == 2


@pytest.mark.parametrize("visits, kind", [(None, "SortMergeJoin"), (7_000_000, "SortMergeJoin"), (5_000, "BroadcastHashJoin")])
def test_the_replicated_side_is_broadcast_only_if_few_rows_were_counted(spark, tables, visits, kind):
    track, _, staging = tables
    crowded = staging.keep(crowded_cells(track), f"crowded_{visits}")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100g")
    try:
        plan = planned(nearest_slots(track, crowded=crowded, visits=visits))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert re.findall(r"(\w+) \[time_bucket#\d+L, lat_cell#\d+L, lon_cell#\d+L, early_part", plan) == [kind]


def test_looking_up_the_nearest_reports_scans_once_and_does_not_shuffle_points(tables):
    track, _, staging = tables
    nearest = staging.keep(nearest_slots(track), "nearest")
    plan = planned(pinpoint(nearest, track))
    assert [key(text) for text in shuffles(plan)] == [["mmsi_1", "mmsi_2", "distance_nm"]]
    assert len(re.findall(r"ReadSchema: struct<[^>]*name", plan)) == 1


def test_crowded_cells_count_before_the_shuffle(tables):
    plan = planned(crowded_cells(tables[0]))
    assert "partial_count" in plan and "ReadSchema: struct<timestamp:timestamp_ntz,latitude:double,longitude:double>" in plan


def test_a_small_stored_candidate_table_is_broadcast_and_the_tracks_stay(tables):
    track, stored, _ = tables
    for stats in (side_stats, after_stats):
        plan = planned(stats(candidate_sides(stored), track))
        assert [keys for keys in map(key, shuffles(plan)) if "mmsi" in keys or "slot" in keys] == []


def test_large_candidates_join_on_vessel_and_hour(tables, no_broadcast):
    track, stored, _ = tables
    plan = planned(side_stats(candidate_sides(stored), track))
    assert [key(text) for text in shuffles(plan)].count(["mmsi", "track_hour"]) == 2
    assert "SortMergeJoin [mmsi" in plan and "track_hour" in plan


def test_stored_tracks_are_joined_where_they_lie(spark, no_broadcast):
    """Without a broadcast, the sides are shuffled to the buckets of the tracks; results are those of tracks that aren't stored."""
    staging = Staging(spark)
    rows = [position(mmsi, 60 * s, 55.0 + s / 1000) for mmsi in ("219000001", "219000002") for s in range(300)]
    plain = remove_gps_jumps(positions(spark, rows))
    stored = staging.keep(candidates(spark, [candidate(seconds=s * 900.0, cid=f"c{s}") for s in range(18)]), "candidates")
    track = stage_tracks(positions(spark, rows), staging)
    for measure in (before_stats, after_stats, trajectory_points):
        sides = stored if measure is trajectory_points else candidate_sides(stored)
        frame = measure(sides, track)
        plan = executed(frame)
        scans = [line for line in plan.split("\n") if "FileScan" in line and "track_hour" in line]
        assert len(scans) == 1 and "Bucketed: true" in scans[0]
        path = above(plan, scans[0])
        assert "SortMergeJoin" in path[-1] and not any("Exchange" in line for line in path), path
        assert sorted(map(str, frame.collect())) == sorted(map(str, measure(sides, plain).collect()))
    staging.remove()
    assert not [t for t in spark.catalog.listTables() if t.name in staging.tables]


def test_types_shrink_before_the_shuffle(tables):
    plan = planned(vessel_types(tables[0]))
    assert "HashAggregate" in plan and "partial_max(timestamp" in plan
    assert "Not(EqualTo(ship_type,Undefined))" in plan


def test_scoring_reads_tracks_for_windows_once(tables, no_broadcast):
    track, stored, _ = tables
    plan = planned(score_candidates(stored, track))
    assert len(re.findall(r"ReadSchema: struct<[^>]*sog", plan)) == 1


def test_paths_read_only_their_columns(tables):
    track, stored, _ = tables
    plan = planned(trajectory_paths(stored, track))
    assert "ReadSchema: struct<mmsi:string,timestamp:timestamp_ntz,latitude:double,longitude:double>" in plan


def test_a_vessel_with_a_third_of_all_rows_is_spread(spark):
    """Most rows are of one vessel: the jump filter's tasks still hold about as many rows each."""
    rows = [position("219000001", hour * 3600 + s, 55.0) for hour in range(200) for s in range(5)]
    rows += [position(f"2190{n:05d}", 0) for n in range(2, 1000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        clean = remove_gps_jumps(positions(spark, rows), JumpRules(edge_mode="limit", segment_seconds=3600))
        sizes = clean.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == len(rows) and max(sizes) < 2 * len(rows) / 8


def test_only_days_near_an_encounter_are_read(spark):
    staging = Staging(spark)
    rows = [position(mmsi, day * 86_400 + s) for mmsi in ("219000001", "219000002") for day in range(6) for s in range(0, 900, 10)]
    track = staging.keep(with_day(positions(spark, rows)), "tracks", by=DAY)
    stored = staging.keep(candidates(spark, [candidate(seconds=2 * 86_400 + 600.0)]), "candidates")
    stats = side_stats(candidate_sides(stored), track)
    scan = next(line for line in executed(stats).split("\n") if "FileScan" in line and "event_date" in line)
    assert re.search(r"PartitionFilters: \[.*array_contains\((Reused)?[sS]ubquery", scan)
    assert sorted(row.before_point_count for row in stats.collect()) == [61, 61]


@pytest.mark.parametrize("rows, folders", [(20_000, 1), (1, 6)])
def test_tracks_are_stored_in_folders_of_so_many_days_that_files_are_not_small(spark, monkeypatch, rows, folders):
    """Six days around a change of folders; statistics are those of tracks that aren't stored, and read only their folder."""
    monkeypatch.setattr(pipeline, "TRACK_FILE_ROWS", rows)
    staging = Staging(spark)
    reports = [position(mmsi, day * 86_400 + s) for mmsi in ("219000001", "219000002") for day in range(6) for s in range(0, 900, 10)]
    track = stage_tracks(positions(spark, reports), staging)
    files = glob.glob(f"{staging.folder}/tracks/**/*.parquet", recursive=True)
    assert len({os.path.dirname(f) for f in files}) == folders and len(files) <= folders * 8
    assert not os.path.exists(f"{staging.folder}/tracks_plain")
    stored = staging.keep(candidates(spark, [candidate(seconds=2 * 86_400 + 600.0)]), "candidates")
    stats = side_stats(candidate_sides(stored), track)
    scan = next(line for line in executed(stats).split("\n") if "FileScan" in line and "first_day" in line)
    assert re.search(r"PartitionFilters: \[.*arrays_overlap\((Reused)?[sS]ubquery", scan)
    plain = side_stats(candidate_sides(stored), remove_gps_jumps(positions(spark, reports)))
    assert sorted(map(str, stats.collect())) == sorted(map(str, plain.collect())) and stats.count() == 2
    staging.remove()
