"""The registered queries: each operator on the reports derived from a folder of given tables.

Every query reads the whole ``events`` table. Times are shown as text and measures rounded to six
decimals, so that another engine's answer can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlead.functions.clock import parse_report_time
from fairlead.functions.geo import bounding_box, haversine_nm
from fairlead.functions.identity import mmsi_rejection
from fairlead.operators import behaviour, collisions, jumps, proximity, results
from fairlead.operators.area import within_area
from fairlead.operators.cleaning import clean_reports, type_reports
from fairlead.params import Circle, CollisionRules, JumpRules, ProximityRules, Rules
from fairlead.plans.incremental import Store
from fairlead.plans.pipeline import ingest, run, stage_candidates, stage_tracks
from fairlead.schema import POSITION_COLUMNS, RAW_COLUMNS, RAW_TIME
from fairlead.sources.documents import write_trajectories
from fairlead.sources.sample import sample_reports
from fairlead.sources.tables import DAY, Staging, merge_positions, read_positions, with_day, write_positions
from fairlead.streaming.ingest import ingest_new_files

Query = Callable[[SparkSession, str], DataFrame]

# Limits under which the sample holds collisions at every size.
SAMPLE_COLLISIONS = CollisionRules(collision_metres=50.0, collision_min_points=10)
SMALL_CIRCLE = Circle(radius_nm=20.0)


def shown(df: DataFrame) -> DataFrame:
    """Times and dates as text, doubles rounded to six decimals, counts as bigint."""

    def value(field: T.StructField) -> Column:
        column = F.col(field.name)
        if isinstance(field.dataType, (T.TimestampNTZType, T.DateType)):
            column = column.cast("string")
        elif isinstance(field.dataType, T.DoubleType):
            column = F.round(column, 6)
        elif isinstance(field.dataType, T.IntegerType):
            column = column.cast("bigint")
        return column.alias(field.name)

    return df.select(*(value(field) for field in df.schema))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_reports(sample_reports(spark, sf_dir))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_tracks(positions(spark, sf_dir), Staging(spark))


def encounters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored tracks and candidates."""
    staging = Staging(spark)
    stored = stage_tracks(positions(spark, sf_dir), staging)
    return stored, stage_candidates(stored, staging)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, candidates = encounters(spark, sf_dir)
    return collisions.score_candidates(candidates, stored, rules=SAMPLE_COLLISIONS)


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.validate_candidates(scored(spark, sf_dir), SAMPLE_COLLISIONS)


def parse_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(
        f"""CASE event_id % 50 WHEN 3 THEN 'not a time' WHEN 7 THEN '1/12/2021 00:00:00'
            WHEN 11 THEN '' WHEN 13 THEN '31/02/2021 00:00:00' ELSE `{RAW_TIME}` END"""
    )
    parsed = sample_reports(spark, sf_dir).select("event_id", text.alias("written"))
    return shown(parsed.select("event_id", "written", parse_report_time(F.col("written")).alias("parsed")))


def cast_numerics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(type_reports(sample_reports(spark, sf_dir))).drop("timestamp")


def mmsi_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.coalesce(mmsi_rejection("mmsi"), F.lit("usable"))
    return type_reports(sample_reports(spark, sf_dir)).groupBy(reason.alias("reason")).agg(F.count("*").alias("reports"))


def clean_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(positions(spark, sf_dir))


def _per_day(table: DataFrame) -> DataFrame:
    return shown(with_day(table).groupBy(DAY).agg(F.count("*").alias("reports")))


def daily_ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_day(positions(spark, sf_dir))


def _report_files(
    spark: SparkSession, sf_dir: str, staging: Staging, which: str = "true", name: str = "all", backwards: bool = False
) -> str:
    """The sample reports as CSV files with a header, as they would arrive."""
    folder = f"{staging.folder}/reports-{name}"
    columns = RAW_COLUMNS[::-1] if backwards else RAW_COLUMNS
    sample_reports(spark, sf_dir).filter(which).select(*(f"`{c}`" for c in columns)).write.option("header", True).option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(folder)
    return folder


def csv_ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    staging = Staging(spark)
    table = f"{staging.folder}/positions"
    ingest(spark, _report_files(spark, sf_dir, staging), table)
    return _per_day(read_positions(spark, table))


def stream_ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    staging = Staging(spark)
    folder, table = _report_files(spark, sf_dir, staging), f"{staging.folder}/positions"
    ingest_new_files(spark, folder, table, f"{staging.folder}/seen")
    return _per_day(read_positions(spark, table))


def mixed_ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the reports by the batch job, the other half, in files of another column order, by the stream; one table."""
    staging = Staging(spark)
    table = f"{staging.folder}/positions"
    even = _report_files(spark, sf_dir, staging, "event_id % 2 = 0", "even")
    odd = _report_files(spark, sf_dir, staging, "event_id % 2 = 1", "odd", backwards=True)
    ingest(spark, even, table)
    ingest_new_files(spark, odd, table, f"{staging.folder}/seen")
    return _per_day(read_positions(spark, table))


def haversine_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    centre = Circle()
    distance = haversine_nm(F.col("latitude"), F.col("longitude"), F.lit(centre.latitude), F.lit(centre.longitude))
    typed = type_reports(sample_reports(spark, sf_dir))
    return shown(typed.select("mmsi", "timestamp", "latitude", "longitude", distance.alias("distance_nm")))


def bounding_box_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    south, north, west, east = bounding_box(SMALL_CIRCLE.latitude, SMALL_CIRCLE.longitude, SMALL_CIRCLE.radius_nm)
    boxed = F.col("latitude").between(south, north) & F.col("longitude").between(west, east)
    return shown(positions(spark, sf_dir).filter(boxed).select("mmsi", "timestamp", "latitude", "longitude"))


def area_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(within_area(positions(spark, sf_dir), SMALL_CIRCLE))


def conflicting_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(jumps.conflicting_instants(positions(spark, sf_dir)))


def drop_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(jumps.drop_conflicts(positions(spark, sf_dir)).select(*POSITION_COLUMNS))


def dedupe_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(jumps.dedupe_positions(positions(spark, sf_dir)))


def unique_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(jumps.unique_positions(positions(spark, sf_dir)))


def neighbour_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    speeds = jumps.neighbour_speeds(jumps.unique_positions(positions(spark, sf_dir)))
    return shown(
        speeds.select(
            "mmsi", "timestamp", "previous_hours", "next_hours", "previous_speed_knots", "next_speed_knots"
        )
    )


def gps_jump_clean(spark: SparkSession, sf_dir: str, edge_mode: str = "strict") -> DataFrame:
    return shown(jumps.remove_gps_jumps(positions(spark, sf_dir), JumpRules(edge_mode=edge_mode)))


def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cell: the reports that lie in it, and the reports that look for partners in it."""
    points = within_area(positions(spark, sf_dir)).select("timestamp", "latitude", "longitude")
    lying = proximity.home_cells(points).withColumn("home", F.lit(1))
    looking = proximity.reached_cells(points).withColumn("home", F.lit(0))
    both = lying.unionByName(looking).groupBy(*proximity.CELL)
    return both.agg(F.sum("home").alias("reports"), F.sum(1 - F.col("home")).alias("visits"))


def proximity_pairs(spark: SparkSession, sf_dir: str, rules: ProximityRules = ProximityRules()) -> DataFrame:
    staging, seen = Staging(spark), Observation("visits of cells")
    points = within_area(stage_tracks(positions(spark, sf_dir), staging))
    crowded = staging.keep(proximity.crowded_cells(points, rules, seen), "crowded")
    return shown(proximity.proximity_pairs(points, rules, crowded, seen.get.get("visits", 0)))


def proximity_pairs_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs, with cells of more than four reports or visits divided, and merged, not broadcast."""
    return proximity_pairs(spark, sf_dir, ProximityRules(split_rows=4, broadcast_visits=0))


def closest_approach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(encounters(spark, sf_dir)[1])


def encounter_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several encounters per pair: meetings more than a minute apart are two."""
    rules = Rules(proximity=ProximityRules(per="encounter", encounter_gap_seconds=60))
    staging = Staging(spark)
    return shown(stage_candidates(stage_tracks(positions(spark, sf_dir), staging, rules), staging, rules))


def candidate_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(behaviour.candidate_sides(encounters(spark, sf_dir)[1]))


def before_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, candidates = encounters(spark, sf_dir)
    return shown(behaviour.before_stats(behaviour.candidate_sides(candidates), stored))


def after_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, candidates = encounters(spark, sf_dir)
    return shown(behaviour.after_stats(behaviour.candidate_sides(candidates), stored))


def side_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, candidates = encounters(spark, sf_dir)
    return shown(behaviour.pivot_sides(behaviour.side_stats(behaviour.candidate_sides(candidates), stored)))


def side_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, candidates = encounters(spark, sf_dir)
    stats = behaviour.before_stats(behaviour.candidate_sides(candidates), stored)
    return shown(behaviour.select_side(stats, "2", "vessel_2"))


def vessel_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behaviour.vessel_types(tracks(spark, sf_dir))


def typed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, candidates = encounters(spark, sf_dir)
    return shown(collisions.with_types(candidates, collisions.candidate_types(candidates, stored)))


def scored_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(scored(spark, sf_dir))


def validated_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(validated(spark, sf_dir))


def collision_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = Staging(spark).keep(validated(spark, sf_dir), "validated")
    return shown(results.collision_rows(stored))


def _document_fields(lines: DataFrame) -> DataFrame:
    entry = F.regexp_replace("value", "^,", "")
    is_entry = F.col("value").contains("candidate_id")
    fields = ("candidate_id", "mmsi_1", "mmsi_2", "name_1", "name_2", "collision_time")
    return lines.select(
        F.when(~is_entry, F.col("value")).alias("frame"),
        *(F.when(is_entry, F.get_json_object(entry, f"$.{name}")).alias(name) for name in fields),
    )


def collision_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the result document, read back."""
    stored = Staging(spark).keep(validated(spark, sf_dir), "validated")
    return _document_fields(results.collision_document(stored))


def trajectory_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, candidates = encounters(spark, sf_dir)
    return shown(results.trajectory_points(candidates, stored))


def trajectory_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, candidates = encounters(spark, sf_dir)
    return shown(results.trajectory_paths(candidates, stored))


def _feature_fields(lines: DataFrame) -> DataFrame:
    def part(path: str) -> Column:
        return F.get_json_object("value", path)

    line = part("$.geometry.coordinates")
    return lines.select(
        part("$.properties.candidate_id").alias("candidate_id"),
        part("$.properties.vessel_side").alias("vessel_side"),
        part("$.properties.label").alias("label"),
        part("$.properties.start").alias("start_time"),
        part("$.properties.end").alias("end_time"),
        part("$.geometry.type").alias("geometry"),
        F.coalesce(F.size(F.from_json(line, "array<array<double>>")), F.lit(0)).cast("bigint").alias("points"),
    )


def trajectory_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The GeoJSON lines, read back."""
    stored, candidates = encounters(spark, sf_dir)
    staging = Staging(spark)
    write_trajectories(candidates, staging.keep(results.path_pieces(candidates, stored), "pieces"), f"{staging.folder}/trajectories")
    return _feature_fields(spark.read.text(f"{staging.folder}/trajectories"))


def _whole_run(spark: SparkSession, sf_dir: str) -> str:
    """From report files to the written results; returns their folder."""
    staging = Staging(spark)
    output = f"{staging.folder}/run"
    run(spark, _report_files(spark, sf_dir, staging), output, Rules(collisions=SAMPLE_COLLISIONS))
    return output


def pipeline_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from report files; the result document as it was written."""
    return _document_fields(spark.read.text(f"{_whole_run(spark, sf_dir)}/collision_result"))


def pipeline_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from report files; the trajectories as they were written."""
    return _feature_fields(spark.read.text(f"{_whole_run(spark, sf_dir)}/collision_trajectories"))


def incremental_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates after two updates: two thirds of the reports, then the rest, which fall on the same days."""
    staging = Staging(spark)
    table = f"{staging.folder}/positions"
    store = Store(spark, table, f"{staging.folder}/store")
    for which, name in (("event_id % 3 > 0", "first"), ("event_id % 3 = 0", "rest")):
        write_positions(clean_reports(sample_reports(spark, sf_dir).filter(which)), table, batch=name)
        store.update()
    merge_positions(spark, table)
    store.update()
    return shown(store.encounters(staging).candidates)


QUERIES: dict[str, Query] = {
    "parse_timestamps": parse_timestamps,
    "cast_numerics": cast_numerics,
    "mmsi_validity": mmsi_validity,
    "clean_positions": clean_positions,
    "daily_ingest_counts": daily_ingest_counts,
    "csv_ingest_counts": csv_ingest_counts,
    "stream_ingest_counts": stream_ingest_counts,
    "mixed_ingest_counts": mixed_ingest_counts,
    "haversine_distance": haversine_distance,
    "bounding_box_filter": bounding_box_filter,
    "area_filter": area_filter,
    "conflicting_positions": conflicting_positions,
    "drop_conflicts": drop_conflicts,
    "dedupe_positions": dedupe_positions,
    "unique_positions": unique_positions,
    "neighbour_speeds": neighbour_speeds,
    "gps_jump_clean": gps_jump_clean,
    "gps_jump_clean_limit": partial(gps_jump_clean, edge_mode="limit"),
    "grid_cells": grid_cells,
    "proximity_pairs": proximity_pairs,
    "proximity_pairs_split": proximity_pairs_split,
    "closest_approach": closest_approach,
    "encounter_candidates": encounter_candidates,
    "candidate_sides": candidate_sides,
    "before_stats": before_stats,
    "after_stats": after_stats,
    "side_selection": side_selection,
    "side_pivot": side_pivot,
    "vessel_types": vessel_types,
    "typed_candidates": typed_candidates,
    "scored_candidates": scored_candidates,
    "validated_collisions": validated_collisions,
    "collision_result": collision_result,
    "collision_document": collision_document,
    "trajectory_points": trajectory_points,
    "trajectory_paths": trajectory_paths,
    "trajectory_features": trajectory_features,
    "pipeline_document": pipeline_document,
    "pipeline_trajectories": pipeline_trajectories,
    "incremental_candidates": incremental_candidates,
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collisions in the sample under the default limits, as result rows."""
    staging, rules = Staging(spark), Rules()
    stored = stage_tracks(positions(spark, sf_dir), staging, rules)
    candidates = stage_candidates(stored, staging, rules)
    scores = collisions.score_candidates(candidates, stored, rules.behaviour, rules.collisions)
    found = staging.keep(collisions.validate_candidates(scores, rules.collisions), "validated")
    return results.collision_rows(found)
