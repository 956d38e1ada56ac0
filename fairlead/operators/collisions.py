"""From encounter candidates to collisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.functions.geo import METRES_PER_NM, haversine_metres
from fairlead.operators.behaviour import candidate_sides, pivot_sides, side_stats, vessel_types
from fairlead.params import BehaviourRules, CollisionRules
from fairlead.schema import CANDIDATE_COLUMNS, CANDIDATE_SCHEMA, SIDES, VALIDATED_COLUMNS, expect


def with_types(candidates: DataFrame, types: DataFrame) -> DataFrame:
    """Adds ``vessel_1_ship_type`` and ``vessel_2_ship_type``; null where the type is not known."""
    for side in SIDES:
        named = types.select(
            F.col("mmsi").alias(f"mmsi_{side}"), F.col("ship_type").alias(f"vessel_{side}_ship_type")
        )
        candidates = candidates.join(named, f"mmsi_{side}", "left")
    return candidates.select(*CANDIDATE_COLUMNS, *(f"vessel_{side}_ship_type" for side in SIDES))


def candidate_types(candidates: DataFrame, tracks: DataFrame) -> DataFrame:
    """``vessel_types`` of the vessels that are part of a candidate, so other tracks drop out early."""
    seen = candidate_sides(candidates).select("mmsi").distinct()
    return vessel_types(tracks.join(seen, "mmsi", "left_semi"))


def _speed_drop(side: str) -> Column:
    before, after = F.col(f"vessel_{side}_before_median_sog"), F.col(f"vessel_{side}_after_speed")
    return F.when(before > 0, (before - after) / before)


def features(joined: DataFrame, rules: CollisionRules = CollisionRules()) -> DataFrame:
    """Movement, speed-drop, approach and type columns from a candidate row with both sides' statistics."""

    def of(side: str, name: str) -> Column:
        return F.col(f"vessel_{side}_{name}")

    def each(name: str, value) -> dict[str, Column]:
        return {f"vessel_{side}_{name}": value(side) for side in SIDES}

    def still(side: str) -> Column:
        return (of(side, "before_median_sog") < rules.stationary_knots) & (
            of(side, "before_moved_meters") < rules.stationary_metres
        )

    measured = joined.withColumns(
        {
            **each(
                "was_moving",
                lambda side: (of(side, "before_median_sog") >= rules.moving_knots)
                | (of(side, "before_moved_meters") >= rules.moving_metres),
            ),
            "both_were_stationary": still("1") & still("2"),
            # Only a speed that was heard counts: silence afterwards is no speed drop.
            **each("after_speed", lambda side: of(side, "after_median_sog")),
            "pre_event_pair_distance_meters": haversine_metres(
                of("1", "first_latitude"), of("1", "first_longitude"), of("2", "first_latitude"), of("2", "first_longitude")
            ),
            "minimum_distance_meters": F.col("minimum_distance_nm") * F.lit(METRES_PER_NM),
            **each("is_excluded_type", lambda side: of(side, "ship_type").isin(*rules.excluded_types)),
        }
    ).withColumns(each("speed_drop_pct", _speed_drop))
    combined = reduce(Column.__add__, (F.coalesce(of(side, "speed_drop_pct"), F.lit(0.0)) for side in SIDES))
    approach = F.col("pre_event_pair_distance_meters") - F.col("minimum_distance_meters")
    return (
        measured.withColumn("combined_speed_drop_pct", combined)
        .withColumn("approach_distance_meters", approach)
        .withColumn("vessels_approached", F.col("approach_distance_meters") > 0)
        .select(*VALIDATED_COLUMNS)
    )


def score_candidates(
    candidates: DataFrame,
    tracks: DataFrame,
    behaviour: BehaviourRules = BehaviourRules(),
    rules: CollisionRules = CollisionRules(),
) -> DataFrame:
    """Every candidate whose vessels were both heard before the encounter, with all its features.

    ``tracks`` should reach beyond the searched area, so that no window is cut at its border.
    """
    expect(candidates, CANDIDATE_SCHEMA)
    typed = with_types(candidates, candidate_types(candidates, tracks))
    stats = pivot_sides(side_stats(candidate_sides(candidates), tracks, behaviour))
    return features(typed.join(stats, "candidate_id"), rules)


def is_collision(rules: CollisionRules = CollisionRules()) -> Column:
    """The collision predicate on a scored row; an unknown test fails."""

    def each(test) -> list[Column]:
        return [test(side) for side in SIDES]

    def of(side: str, name: str) -> Column:
        return F.col(f"vessel_{side}_{name}")

    tests = [
        *each(lambda side: of(side, "was_moving")),
        *each(lambda side: of(side, "before_point_count") >= rules.min_points),
        *each(lambda side: of(side, "before_median_sog") >= rules.moving_knots),
        *each(lambda side: of(side, "before_moved_meters") >= rules.moving_metres),
        ~F.col("both_were_stationary"),
        F.col("minimum_distance_meters") <= rules.collision_metres,
        F.col("combined_speed_drop_pct") >= rules.min_speed_drop,
        *each(lambda side: of(side, "before_point_count") >= rules.collision_min_points),
        *each(lambda side: of(side, "before_moved_meters") >= rules.collision_moved_metres),
        F.col("approach_distance_meters") >= rules.collision_approach_metres,
        # A vessel of unknown type is not excluded.
        *each(lambda side: ~F.coalesce(of(side, "is_excluded_type"), F.lit(False))),
    ]
    return reduce(Column.__and__, tests)


def validate_candidates(scored: DataFrame, rules: CollisionRules = CollisionRules()) -> DataFrame:
    """The scored candidates that count as collisions."""
    return scored.filter(is_collision(rules))
