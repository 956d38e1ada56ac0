from __future__ import annotations

import glob
import json

import pytest
from helpers import at, candidate, candidates, position, positions
from pyspark.sql import functions as F

from fairlead.operators.collisions import features, is_collision, score_candidates, validate_candidates
from fairlead.operators.results import (
    collision_document,
    collision_rows,
    feature_parts,
    path_pieces,
    trajectory_paths,
    trajectory_points,
)
from fairlead.params import BehaviourRules, CollisionRules
from fairlead.schema import CANDIDATE_SCHEMA, POSITION_COLUMNS, POSITION_SCHEMA, VALIDATED_COLUMNS, VALIDATED_SCHEMA
from fairlead.sources.documents import write_trajectories
from fairlead.sources.tables import Staging

ONE, TWO = "219000001", "219000002"

# The published result: one row of features, as far as it follows from the statistics.
PUBLISHED = {
    "candidate_id": "0389973fd3f46f26aac71fa450c5c942864b81d7e7a1ebf0a6a9596bae51cf35",
    "mmsi_1": "219021240",
    "mmsi_2": "232018267",
    "name_1": "KARIN HOEJ",
    "name_2": "MV SCOT CARRIER",
    "collision_time": at(1663),
    "collision_latitude": 55.2230795,
    "collision_longitude": 14.2437065,
    "minimum_distance_nm": 0.002200806421116268,
    "vessel_1_ship_type": "Other",
    "vessel_2_ship_type": "Cargo",
    "vessel_1_before_point_count": 55,
    "vessel_1_before_median_sog": 6.0,
    "vessel_1_before_moved_meters": 1787.9973641125039,
    "vessel_1_first_latitude": 55.235113,
    "vessel_1_first_longitude": 14.262408,
    "vessel_1_last_latitude": 55.223067,
    "vessel_1_last_longitude": 14.24373,
    "vessel_2_before_point_count": 96,
    "vessel_2_before_median_sog": 11.8,
    "vessel_2_before_moved_meters": 3278.000445808259,
    "vessel_2_first_latitude": 55.235347,
    "vessel_2_first_longitude": 14.291273,
    "vessel_2_last_latitude": 55.223112,
    "vessel_2_last_longitude": 14.244242,
    "vessel_1_after_point_count": 0,
    "vessel_1_after_median_sog": None,
    "vessel_2_after_point_count": 166,
    "vessel_2_after_median_sog": 8.8,
}
DERIVED = {
    "vessel_1_was_moving": True,
    "vessel_2_was_moving": True,
    "both_were_stationary": False,
    "vessel_1_after_speed": None,
    "vessel_2_after_speed": 8.8,
    "vessel_1_speed_drop_pct": None,
    "vessel_2_speed_drop_pct": 0.2542372881355932,
    "combined_speed_drop_pct": 0.2542372881355932,
    "pre_event_pair_distance_meters": 1830.3155288873609,
    "minimum_distance_meters": 4.075893491907329,
    "approach_distance_meters": 1826.2396353954534,
    "vessels_approached": True,
    "vessel_1_is_excluded_type": False,
    "vessel_2_is_excluded_type": False,
}


def joined(spark, *changes):
    rows = [tuple((PUBLISHED | change)[name] for name in PUBLISHED) for change in changes or ({},)]
    layout = [field for field in VALIDATED_SCHEMA if field.name in PUBLISHED]
    return spark.createDataFrame(rows, type(VALIDATED_SCHEMA)(layout))


def test_published_features(spark):
    row = features(joined(spark)).first().asDict()
    assert tuple(row) == VALIDATED_COLUMNS
    for name, value in DERIVED.items():
        assert row[name] == (pytest.approx(value, abs=1e-6) if isinstance(value, float) else value), name
    assert validate_candidates(features(joined(spark))).count() == 1


@pytest.mark.parametrize(
    "change, kept",
    [
        ({"minimum_distance_nm": 5.01 / 1852}, False),
        ({"vessel_1_before_point_count": 20}, True),
        ({"vessel_1_before_point_count": 19}, False),
        ({"vessel_2_before_point_count": 19}, False),
        ({"vessel_1_before_median_sog": 0.9}, False),
        ({"vessel_1_before_median_sog": None}, False),
        ({"vessel_1_before_moved_meters": 999.0}, False),
        ({"vessel_2_before_moved_meters": 999.0}, False),
        ({"vessel_2_after_median_sog": 9.5}, False),
        ({"vessel_2_after_median_sog": None, "vessel_2_after_point_count": 0}, False),
        # A vessel that speeds up offsets the other's drop.
        ({"vessel_1_after_median_sog": 7.0}, False),
        ({"vessel_2_first_latitude": 55.235113, "vessel_2_first_longitude": 14.262408}, False),
        ({"vessel_1_ship_type": "Pilot"}, False),
        ({"vessel_2_ship_type": "Pilot"}, False),
        ({"vessel_1_ship_type": None, "vessel_2_ship_type": None}, True),
    ],
)
def test_each_limit(spark, change, kept):
    assert features(joined(spark, change)).filter(is_collision()).count() == kept


def test_loose_limits_matter_when_the_strict_ones_are_lowered(spark):
    rules = CollisionRules(collision_min_points=0, collision_moved_metres=0.0, moving_knots=0.0)
    assert features(joined(spark, {"vessel_1_before_point_count": 2}), rules).filter(is_collision(rules)).count() == 0
    assert features(joined(spark, {"vessel_1_before_moved_meters": 99.0}), rules).filter(is_collision(rules)).count() == 0
    still = {f"vessel_{side}_before_{name}": 0.1 for side in "12" for name in ("median_sog", "moved_meters")}
    flags = features(joined(spark, still)).first()
    assert flags.both_were_stationary and not flags.vessel_1_was_moving


def tracks_of_a_collision(spark):
    """Two vessels half a degree apart meet at second 1000; the first goes silent, the second slows."""
    rows = []
    for second in range(400, 1001, 20):
        rows.append(position(ONE, second, 55 - (1000 - second) * 0.00003, sog=10.0, ship_type="Cargo", name="ONE"))
        rows.append(position(TWO, second, 55 + (1000 - second) * 0.00003, sog=12.0, ship_type="Undefined", name="TWO"))
    rows += [position(TWO, second, 55.0, sog=3.0, name="TWO") for second in range(1020, 1601, 20)]
    return positions(spark, rows)


def test_scoring_from_tracks(spark):
    table = candidates(spark, [candidate(seconds=1000), candidate("c2", ONE, "219000009", 1000)])
    scored = score_candidates(table, tracks_of_a_collision(spark))
    assert [(f.name, f.dataType) for f in scored.schema] == [(f.name, f.dataType) for f in VALIDATED_SCHEMA]
    (row,) = scored.collect()  # the second candidate has a vessel nobody heard
    assert (row.vessel_1_ship_type, row.vessel_2_ship_type) == ("Cargo", None)
    assert (row.vessel_1_before_point_count, row.vessel_1_after_point_count) == (31, 0)
    assert (row.vessel_2_before_point_count, row.vessel_2_after_point_count) == (31, 30)
    assert row.combined_speed_drop_pct == pytest.approx(0.75)
    assert row.vessel_1_is_excluded_type is False and row.vessel_2_is_excluded_type is None
    assert validate_candidates(scored).count() == 1


def document(frame):
    return json.loads("".join(row.value for row in collision_document(frame).collect()))


def test_document_of_none_one_and_many(spark):
    one = features(joined(spark))
    assert document(one.limit(0)) == {"collision_found": False}
    single = document(one)
    assert single.keys() == set(VALIDATED_COLUMNS) | {"collision_found"}
    assert single["collision_time"] == "2021-12-13 02:27:43"
    assert single["vessel_1_after_speed"] is None
    later = {"candidate_id": "b", "collision_time": at(5000)}
    tied = {"candidate_id": "a", "collision_time": at(5000)}
    many = document(features(joined(spark, later, {}, tied)))
    assert (many["collision_found"], many["collision_count"]) == (True, 3)
    assert [item["candidate_id"] for item in many["collisions"]] == [PUBLISHED["candidate_id"], "a", "b"]
    assert all(item["collision_found"] for item in many["collisions"])


def test_result_rows(spark):
    rows = collision_rows(features(joined(spark, {"candidate_id": "z", "collision_time": at(0)}, {}))).collect()
    assert [row.candidate_id for row in rows] == ["z", PUBLISHED["candidate_id"]]
    assert {(row.collision_found, row.collision_count) for row in rows} == {(True, 2)}


def test_trajectories(spark, tmp_path):
    tracks, table = tracks_of_a_collision(spark), candidates(spark, [candidate(seconds=1000)])
    points = trajectory_points(table, tracks)
    assert points.groupBy("vessel_side").count().orderBy("vessel_side").collect() == [("1", 31), ("2", 61)]
    paths, pieces = trajectory_paths(table, tracks), path_pieces(table, tracks)
    first = paths.filter("vessel_side = '1'").first()
    assert (first.label, first.n_points) == (f"ONE ({ONE})", 31)
    assert (first.start_ts, first.end_ts) == (at(400), at(1000))
    points = [p.timestamp for row in pieces.filter("vessel_side = '1'").orderBy("piece").collect() for p in row.points]
    assert points == sorted(points) and len(points) == 31
    shapes = sorted(written(table, pieces, tmp_path), key=lambda shape: shape["properties"]["vessel_side"])
    assert [shape["properties"]["vessel_side"] for shape in shapes] == ["1", "2"]
    assert shapes[0]["geometry"]["type"] == "LineString"
    assert shapes[0]["geometry"]["coordinates"][-1] == [14.0, 55.0]
    assert shapes[0]["properties"]["start"] == str(at(400))


def written(table, pieces, folder):
    """The features in the written files, one on each line."""
    write_trajectories(table, pieces, f"{folder}/trajectories")
    files = [open(name).read() for name in glob.glob(f"{folder}/trajectories/part-*")]
    return [json.loads(line) for text in files for line in (text.split("\n") if text else ())]


def test_single_fix_is_a_point(spark, tmp_path):
    tracks, table = positions(spark, [position(ONE, 600)]), candidates(spark, [candidate()])
    (shape,) = written(table, path_pieces(table, tracks), tmp_path)
    assert shape["geometry"] == {"type": "Point", "coordinates": [14.0, 55.0]}


def test_the_parts_of_a_path_come_into_one_file_every_time(spark, tmp_path):
    """In one of some fifteen writes they did not; which stage ends first decides."""
    tracks, table = positions(spark, [position(ONE, 600)]), candidates(spark, [candidate()])
    for turn in range(20):
        (shape,) = written(table, path_pieces(table, tracks), tmp_path / str(turn))
        assert shape["geometry"]["coordinates"] == [14.0, 55.0]


def test_no_row_holds_a_whole_day_s_path(spark, tmp_path):
    """A window of a day, a point every second: rows of at most an hour, and the file has the whole path on its line."""
    row = position(ONE, 0)
    tracks = spark.range(86_400).selectExpr(
        *(f"timestampadd(SECOND, id, TIMESTAMP_NTZ'{at(0)}') AS timestamp" if name == "timestamp" else f"{'NULL' if value is None else repr(value)} AS {name}" for name, value in zip(POSITION_COLUMNS, row)),
    )
    tracks = tracks.select(*(F.col(f.name).cast(f.dataType) for f in POSITION_SCHEMA)).withColumn("latitude", 55 + F.second("timestamp") / 1000)
    table = candidates(spark, [candidate(cid=cid, seconds=43_200.0) for cid in ("c1", "c2", "c3")])
    pieces = Staging(spark).keep(path_pieces(table, tracks, BehaviourRules(window_minutes=720)), "pieces")
    assert pieces.selectExpr("max(size(points))").first()[0] == 3600
    assert feature_parts(table, pieces).selectExpr("max(length(value))").first()[0] < 3600 * 25
    shapes = written(table, pieces, tmp_path)
    assert sorted(shape["properties"]["candidate_id"] for shape in shapes) == ["c1", "c2", "c3"]
    assert all(shape["geometry"]["coordinates"] == [[14.0, 55 + s % 60 / 1000] for s in range(86_400)] for shape in shapes)


def test_layout_errors_name_the_column(spark):
    wrong = candidates(spark, [candidate()]).withColumn("collision_time", F.col("collision_time").cast("string"))
    assert wrong.columns == CANDIDATE_SCHEMA.names
    with pytest.raises(ValueError, match="collision_time: expected timestamp_ntz, found string"):
        score_candidates(wrong, tracks_of_a_collision(spark))
