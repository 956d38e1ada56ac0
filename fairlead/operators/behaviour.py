"""What each vessel of a candidate did before and after the encounter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.functions.clock import epoch_seconds
from fairlead.functions.geo import haversine_metres
from fairlead.params import BehaviourRules
from fairlead.schema import (
    AFTER_FIELDS,
    BEFORE_FIELDS,
    CANDIDATE_SCHEMA,
    DAY,
    FIRST_DAY,
    HOUR,
    HOUR_SECONDS,
    LAST_DAY,
    POSITION_SCHEMA,
    SIDE_SCHEMA,
    SIDES,
    expect,
)

_SIDE = ("candidate_id", "vessel_side")
_BEFORE = tuple(name for name, _ in BEFORE_FIELDS)
_AFTER = tuple(name for name, _ in AFTER_FIELDS)


def candidate_sides(candidates: DataFrame) -> DataFrame:
    """Each candidate as two rows, side "1" and side "2"."""
    expect(candidates, CANDIDATE_SCHEMA, ["candidate_id", "mmsi_1", "mmsi_2", "collision_time"])
    both = F.array(
        *(F.struct(F.lit(side).alias("vessel_side"), F.col(f"mmsi_{side}").alias("mmsi")) for side in SIDES)
    )
    return candidates.select("candidate_id", "collision_time", F.inline(both))


def reports_around(
    sides: DataFrame, tracks: DataFrame, before_seconds: int, after_seconds: int, columns: list[str]
) -> DataFrame:
    """The track rows of each side from ``before_seconds`` before to ``after_seconds`` after, both included.

    An interval join turned into an equi-join on (vessel, hour): a side visits the hours its interval
    touches, and the exact bounds are checked on what meets. An hour of one vessel holds at most one row per second, so the work per
    side is bounded whatever the length of the track. Stored tracks are bucketed by vessel and hour; they are then joined where they lie. If the
    tracks have their day as a column, or the days of their folder, as stored tracks do, Spark reads only the days that some side looks at.
    """
    expect(sides, SIDE_SCHEMA)
    needed = ["mmsi", "timestamp", *columns]
    stored = [name for name in (HOUR, DAY, FIRST_DAY, LAST_DAY) if name in tracks.columns]
    track = expect(tracks, POSITION_SCHEMA, needed).select(*needed, *stored)
    if HOUR not in stored:
        track = track.withColumn(HOUR, F.floor(epoch_seconds(F.col("timestamp")) / HOUR_SECONDS))
    when = epoch_seconds(F.col("collision_time"))
    start = F.col("collision_time") - F.expr(f"INTERVAL {int(before_seconds)} SECONDS")
    end = F.col("collision_time") + F.expr(f"INTERVAL {int(after_seconds)} SECONDS")
    if DAY in stored or FIRST_DAY in stored:
        # The days looked at as one value, a few bytes a day; days of the table are tested with it while the query runs.
        looked = sides.select(F.explode(F.sequence(F.to_date(start), F.to_date(end))).alias("day"))
        days = looked.agg(F.collect_set("day")).scalar()
        own = F.array_contains(days, F.col(DAY)) if DAY in stored else F.arrays_overlap(days, F.sequence(FIRST_DAY, LAST_DAY))
        track = track.filter(own)
    hours = F.sequence(
        F.floor((when - before_seconds) / HOUR_SECONDS), F.floor((when + after_seconds) / HOUR_SECONDS)
    )
    met = sides.withColumn(HOUR, F.explode(hours)).join(track, ["mmsi", HOUR])
    return met.filter(F.col("timestamp").between(start, end)).drop(HOUR, DAY, FIRST_DAY, LAST_DAY)


def _lower_median(condition: str) -> Column:
    """The exact lower median of the speeds of rows for which ``condition`` holds, at any number of rows."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN {condition} THEN sog END)")


def _before_aggregates(early: str) -> list[Column]:
    place, at = F.struct("latitude", "longitude"), F.when(F.expr(early), F.col("timestamp"))
    return [
        F.count_if(F.expr(early)).alias("before_point_count"),
        _lower_median(early).alias("before_median_sog"),
        F.min_by(place, at).alias("first"),
        F.max_by(place, at).alias("last"),
    ]


def _after_aggregates(late: str) -> list[Column]:
    return [
        F.count_if(F.expr(late)).alias("after_point_count"),
        _lower_median(late).alias("after_median_sog"),
    ]


def _with_places(stats: DataFrame) -> DataFrame:
    return (
        stats.withColumn("first_latitude", F.col("first.latitude"))
        .withColumn("first_longitude", F.col("first.longitude"))
        .withColumn("last_latitude", F.col("last.latitude"))
        .withColumn("last_longitude", F.col("last.longitude"))
        .withColumn(
            "before_moved_meters",
            haversine_metres(
                F.col("first_latitude"), F.col("first_longitude"), F.col("last_latitude"), F.col("last_longitude")
            ),
        )
    )


def before_stats(sides: DataFrame, tracks: DataFrame, rules: BehaviourRules = BehaviourRules()) -> DataFrame:
    """Statistics over the closed window [t - w, t]; a side without a report there has no row."""
    near = reports_around(sides, tracks, rules.window_minutes * 60, 0, ["latitude", "longitude", "sog"])
    return _with_places(near.groupBy(*_SIDE).agg(*_before_aggregates("true"))).select(*_SIDE, *_BEFORE)


def after_stats(sides: DataFrame, tracks: DataFrame, rules: BehaviourRules = BehaviourRules()) -> DataFrame:
    """Statistics over the half-open window (t, t + w]; every side has a row, with count 0 if silent.

    The sides join the grouped rows, not the track, so that a small ``sides`` can be broadcast.
    """
    near = reports_around(sides, tracks, 0, rules.window_minutes * 60, ["sog"])
    late = near.filter(F.col("timestamp") > F.col("collision_time"))
    heard = late.groupBy(*_SIDE).agg(*_after_aggregates("true"))
    return sides.select(*_SIDE).join(heard, list(_SIDE), "left").fillna({"after_point_count": 0})


def side_stats(sides: DataFrame, tracks: DataFrame, rules: BehaviourRules = BehaviourRules()) -> DataFrame:
    """``before_stats`` with the columns of ``after_stats`` added, in one pass over the tracks.

    One join over [t - w, t + w] and one conditional aggregation. Sides without a report before the
    encounter have no row, as in ``before_stats``.
    """
    window = rules.window_minutes * 60
    near = reports_around(sides, tracks, window, window, ["latitude", "longitude", "sog"])
    early, late = "timestamp <= collision_time", "timestamp > collision_time"
    stats = near.groupBy(*_SIDE).agg(*_before_aggregates(early), *_after_aggregates(late))
    return _with_places(stats).filter(F.col("before_point_count") > 0).select(*_SIDE, *_BEFORE, *_AFTER)


def select_side(stats: DataFrame, side: str, prefix: str) -> DataFrame:
    """The rows of one side, its columns renamed to ``<prefix>_<column>``."""
    own = stats.filter(F.col("vessel_side") == side)
    return own.select(
        "candidate_id", *(F.col(name).alias(f"{prefix}_{name}") for name in own.columns if name not in _SIDE)
    )


def pivot_sides(stats: DataFrame) -> DataFrame:
    """One row per candidate with both sides: ``vessel_1_*`` and ``vessel_2_*``.

    A candidate with statistics for one side only is dropped. One small aggregation takes the place
    of a join per side.
    """
    names = [name for name in stats.columns if name not in _SIDE]
    both = stats.groupBy("candidate_id").agg(
        F.count(F.lit(1)).alias("sides"),
        *(
            F.max(F.when(F.col("vessel_side") == side, F.col(name))).alias(f"vessel_{side}_{name}")
            for side in SIDES
            for name in names
        ),
    )
    return both.filter(F.col("sides") == len(SIDES)).drop("sides")


def vessel_types(tracks: DataFrame) -> DataFrame:
    """Latest known ship type of each vessel ("Undefined" counts as unknown).

    Two steps: the newest time of each (vessel, type), a plain hash aggregation that shrinks the
    table to a few rows per vessel before anything is shuffled, then the newest of those.
    """
    known = expect(tracks, POSITION_SCHEMA, ["mmsi", "timestamp", "ship_type"]).filter(
        F.col("ship_type").isNotNull() & (F.col("ship_type") != "Undefined")
    )
    newest = known.groupBy("mmsi", "ship_type").agg(F.max("timestamp").alias("timestamp"))
    return (
        newest.groupBy("mmsi")
        .agg(F.max(F.struct("timestamp", "ship_type")).alias("latest"))
        .select("mmsi", F.col("latest.ship_type").alias("ship_type"))
    )
