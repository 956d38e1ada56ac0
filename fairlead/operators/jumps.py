"""Duplicate reports and GPS jumps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairlead.functions.clock import epoch_seconds
from fairlead.functions.geo import haversine_nm
from fairlead.params import JumpRules
from fairlead.schema import POSITION_COLUMNS, POSITION_SCHEMA, expect

_INSTANT = ("mmsi", "timestamp")
_PLACE = ("latitude", "longitude")
_REST = tuple(name for name in POSITION_COLUMNS if name not in _INSTANT + _PLACE)


def conflicting_instants(positions: DataFrame) -> DataFrame:
    """(mmsi, timestamp) keys at which a vessel reports more than one position."""
    placed = positions.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    # Plain numbers, which a hash aggregation can hold; places differ if one of their numbers does.
    spread = placed.groupBy(*_INSTANT).agg(*(f(c).alias(f"{n}_{c}") for c in _PLACE for n, f in (("low", F.min), ("high", F.max))))
    differs = reduce(Column.__or__, (F.col(f"low_{c}") != F.col(f"high_{c}") for c in _PLACE))
    return spread.filter(differs).select(*_INSTANT)


def drop_conflicts(positions: DataFrame) -> DataFrame:
    """Positions without every row of a conflicting instant; copies of a row stay."""
    return positions.join(conflicting_instants(positions), list(_INSTANT), "left_anti")


def dedupe_positions(positions: DataFrame) -> DataFrame:
    """One row per vessel, time and place: the smallest of the other columns, compared in order."""
    chosen = positions.groupBy(*_INSTANT, *_PLACE).agg(F.min(F.struct(*_REST)).alias("rest"))
    return chosen.select(*_INSTANT, *_PLACE, "rest.*").select(*POSITION_COLUMNS)


def unique_positions(positions: DataFrame) -> DataFrame:
    """``dedupe_positions(drop_conflicts(positions))`` in one aggregation.

    Both come from the smallest and largest place of an instant, so the input is read and shuffled
    once, and an instant repeated a billion times leaves each map task as a single row.
    """
    expect(positions, POSITION_SCHEMA)
    present = reduce(Column.__and__, (F.col(name).isNotNull() for name in _INSTANT + _PLACE))
    spread = (
        positions.filter(present)
        .groupBy(*_INSTANT)
        .agg(F.min(F.struct(*_PLACE, *_REST)).alias("low"), F.max(F.struct(*_PLACE)).alias("high"))
    )
    same_place = (F.col("low.latitude") == F.col("high.latitude")) & (
        F.col("low.longitude") == F.col("high.longitude")
    )
    return spread.filter(same_place).select(*_INSTANT, "low.*").select(*POSITION_COLUMNS)


def _leg(start: str, end: str) -> tuple[Column, Column]:
    """Hours and implied knots between two fixes; null knots unless time has passed."""
    hours = (epoch_seconds(F.col(f"{end}.timestamp")) - epoch_seconds(F.col(f"{start}.timestamp"))) / 3600
    miles = haversine_nm(
        F.col(f"{start}.latitude"),
        F.col(f"{start}.longitude"),
        F.col(f"{end}.latitude"),
        F.col(f"{end}.longitude"),
    )
    return hours, F.when(hours > 0, miles / hours)


SEGMENT = "segment"
_ENDS = (("head", F.min, F.min_by), ("tail", F.max, F.max_by))


def with_segment(unique: DataFrame, segment_seconds: int = JumpRules.segment_seconds) -> DataFrame:
    return unique.withColumn(SEGMENT, F.floor(epoch_seconds(F.col("timestamp")) / segment_seconds))


def segment_ends(slices: DataFrame) -> DataFrame:
    """First and last fix (``head``, ``tail``) of each vessel and segment, by a hash aggregation of single numbers."""
    ends = slices.groupBy("mmsi", SEGMENT).agg(
        *(edge("timestamp").alias(f"{name}_timestamp") for name, edge, _ in _ENDS),
        *(at(place, "timestamp").alias(f"{name}_{place}") for name, _, at in _ENDS for place in _PLACE),
    )
    fixes = (
        F.struct(*(F.col(f"{name}_{column}").alias(column) for column in ("timestamp", *_PLACE))).alias(name)
        for name, _, _ in _ENDS
    )
    return ends.select("mmsi", SEGMENT, *fixes)


def segment_links(ends: DataFrame) -> DataFrame:
    """For each vessel and segment the last fix before it and the first one after it; a table of one row per segment."""
    along = Window.partitionBy("mmsi").orderBy(SEGMENT)
    return ends.select(
        "mmsi",
        SEGMENT,
        F.lag("tail").over(along).alias("tail_before"),
        F.lead("head").over(along).alias("head_after"),
    )


def neighbour_speeds(
    unique: DataFrame, segment_seconds: int = JumpRules.segment_seconds, links: DataFrame | None = None
) -> DataFrame:
    """Adds hours and implied knots to the vessel's previous and next position.

    ``unique`` holds one row per vessel and time. A track is cut into time segments, so the largest
    window group is one segment of one vessel, however many reports the vessel has in total. The
    neighbours across a segment border come from a small table with one row per vessel and segment. ``links``, if given, is
    that table, of all segments; ``unique`` may then hold some segments only, each whole.
    """
    fix = F.struct(F.col("timestamp"), *(F.col(name) for name in _PLACE))
    slices = with_segment(unique, segment_seconds)
    links = segment_links(segment_ends(slices)) if links is None else links
    within = Window.partitionBy("mmsi", SEGMENT).orderBy("timestamp")
    # A left join: it adds no null test to ``slices``, so both readings of the input stay alike and
    # Spark shuffles it once.
    linked = slices.join(links, ["mmsi", SEGMENT], "left").select(
        *unique.columns,
        fix.alias("here"),
        F.coalesce(F.lag(fix).over(within), F.col("tail_before")).alias("previous"),
        F.coalesce(F.lead(fix).over(within), F.col("head_after")).alias("next"),
    )
    previous_hours, previous_knots = _leg("previous", "here")
    next_hours, next_knots = _leg("here", "next")
    return linked.select(
        *unique.columns,
        previous_hours.alias("previous_hours"),
        next_hours.alias("next_hours"),
        previous_knots.alias("previous_speed_knots"),
        next_knots.alias("next_speed_knots"),
    )


def believable(rules: JumpRules) -> Column:
    """Predicate on the two implied speeds; see ``JumpRules`` for the two edge modes."""
    previous, following = F.col("previous_speed_knots"), F.col("next_speed_knots")
    # Not "both above": one at or below the limit. Unknown unless a known speed decides.
    middle = (previous <= rules.speed_knots) | (following <= rules.speed_knots)
    if rules.edge_mode == "strict":
        # Whatever passes here also passes the edge test: it has a known speed below the lower limit.
        return middle
    return (
        F.when(previous.isNull(), F.coalesce(following <= rules.edge_speed_knots, F.lit(True)))
        .when(following.isNull(), previous <= rules.edge_speed_knots)
        .otherwise(middle)
    )


def remove_gps_jumps(positions: DataFrame, rules: JumpRules = JumpRules()) -> DataFrame:
    """Positions without conflicting instants, copies, and points no vessel could have reached."""
    speeds = neighbour_speeds(unique_positions(positions), rules.segment_seconds)
    return speeds.filter(believable(rules)).select(*POSITION_COLUMNS)
