"""From report files to collisions and trajectories.

Tables are stored on the way where more than one later step reads them or where their size decides
how a join runs: tracks, crowded grid cells, nearest slots, candidates, scored and validated rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fairlead.functions.clock import epoch_seconds
from fairlead.operators.area import within_area
from fairlead.operators.cleaning import clean_reports
from fairlead.operators.collisions import score_candidates, validate_candidates
from fairlead.operators.jumps import remove_gps_jumps
from fairlead.operators.proximity import closest_approach, crowded_cells, nearest_slots, pinpoint
from fairlead.operators.results import path_pieces
from fairlead.params import Rules
from fairlead.schema import FIRST_DAY, HOUR, HOUR_SECONDS, LAST_DAY
from fairlead.sources.documents import write_collision_document, write_trajectories
from fairlead.sources.reports import read_mixed_reports
from fairlead.sources.tables import Staging, read_positions, write_positions


@dataclass(frozen=True)
class Encounters:
    """Tables of a run. ``candidates`` come from the area, ``tracks`` reach beyond it."""

    tracks: DataFrame
    candidates: DataFrame
    scored: DataFrame
    validated: DataFrame


def ingest(spark: SparkSession, folder: str, table: str, rules: Rules = Rules(), mode: str = "overwrite") -> None:
    """Clean every report file of ``folder`` into a position table, in one job.

    The whole folder is read each time, so the table begins anew unless ``mode="append"`` adds to it. For new files only
    there is ``streaming.ingest.ingest_new_files``, on the same tables.
    """
    write_positions(clean_reports(read_mixed_reports(spark, folder), rules.reports), table, mode)


# Rows of a stored track file at least, if there are as many: a folder holds so many days.
TRACK_FILE_ROWS = 20_000


def keep_tracks(tracks: DataFrame, staging: Staging, name: str = "tracks") -> DataFrame:
    """Cleaned positions, stored by days and bucketed by vessel and hour: what looks at reports around an encounter reads only its days, and
    no track is shuffled for it again. A vessel with very many reports is dealt to all buckets, hour by hour.

    A folder holds one day, or so many that its files, one a bucket, have about ``TRACK_FILE_ROWS`` rows. How many that are is counted on the
    tracks, which are stored without buckets for it and deleted when they are dealt out.
    """
    apart = Staging(staging.spark, f"{staging.folder}/{name}_plain")
    plain = apart.keep(tracks, "rows")
    day, second = F.to_date("timestamp"), epoch_seconds(F.col("timestamp"))
    counted = plain.agg(F.count(F.lit(1)), F.count_distinct(day), F.min(day), F.datediff(F.max(day), F.min(day)) + 1)
    rows, days, origin, span = counted.first()
    buckets = int(staging.spark.conf.get("spark.sql.shuffle.partitions"))
    together = max(1, min(buckets * TRACK_FILE_ROWS * days // max(rows, 1), span or 1))
    first = F.date_sub(day, F.pmod(F.datediff(day, F.lit(origin).cast("date")), F.lit(together)))
    dated = plain.withColumn(FIRST_DAY, first).withColumn(LAST_DAY, F.date_add(first, together - 1))
    by_hour = dated.withColumn(HOUR, F.floor(second / HOUR_SECONDS))
    stored = staging.keep(by_hour, name, by=(FIRST_DAY, LAST_DAY), bucket_by=("mmsi", HOUR), buckets=buckets)
    apart.remove()
    return stored


def stage_tracks(positions: DataFrame, staging: Staging, rules: Rules = Rules()) -> DataFrame:
    """Tracks without jumps, stored by ``keep_tracks``."""
    return keep_tracks(remove_gps_jumps(positions, rules.jumps), staging)


def stage_candidates(tracks: DataFrame, staging: Staging, rules: Rules = Rules()) -> DataFrame:
    """Candidates. The area is stored once, with the five columns that the next steps read, each more than once."""
    inside = within_area(tracks, rules.area).select("mmsi", "timestamp", "latitude", "longitude", "name")
    points = staging.keep(inside, "area")
    seen = Observation("visits of cells")
    crowded = staging.keep(crowded_cells(points, rules.proximity, seen), "crowded")
    nearest = staging.keep(nearest_slots(points, rules.proximity, crowded, seen.get.get("visits", 0)), "nearest")
    return staging.keep(closest_approach(pinpoint(nearest, points, rules.proximity)), "candidates")


def find_encounters(positions: DataFrame, staging: Staging, rules: Rules = Rules()) -> Encounters:
    """Cleaned positions -> tracks, candidates, scores and collisions."""
    tracks = stage_tracks(positions, staging, rules)
    candidates = stage_candidates(tracks, staging, rules)
    scored = staging.keep(score_candidates(candidates, tracks, rules.behaviour, rules.collisions), "scored")
    validated = staging.keep(validate_candidates(scored, rules.collisions), "validated")
    return Encounters(tracks, candidates, scored, validated)


def run(spark: SparkSession, folder: str, output: str, rules: Rules = Rules()) -> Encounters:
    """The whole way from a folder of report files.

    Under ``output``: the position table by day, the stored tables, the result document and the
    trajectories of all collisions.
    """
    positions = f"{output}/positions"
    ingest(spark, folder, positions, rules, mode="overwrite")
    staging = Staging(spark, f"{output}/tables")
    found = find_encounters(read_positions(spark, positions), staging, rules)
    write_collision_document(found.validated, f"{output}/collision_result")
    pieces = staging.keep(path_pieces(found.validated, found.tracks, rules.behaviour), "pieces")
    write_trajectories(found.validated, pieces, f"{output}/collision_trajectories")
    return found
