"""Collision results and trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.functions.clock import epoch_seconds, time_text
from fairlead.operators.behaviour import candidate_sides, reports_around
from fairlead.params import BehaviourRules
from fairlead.schema import CANDIDATE_SCHEMA, SIDES, VALIDATED_COLUMNS, VALIDATED_SCHEMA, expect

_NO_COLLISION = '{"collision_found":false}'
_KEEP_NULLS = {"ignoreNullFields": "false"}
_PATH = ("candidate_id", "vessel_side", "mmsi")
#: Length in seconds of the pieces a path is kept in.
PIECE_SECONDS = 3600
_IN_ORDER = ("collision_time", "candidate_id")


def collision_rows(validated: DataFrame) -> DataFrame:
    """The collisions in order of time, each with ``collision_found`` and the number found."""
    expect(validated, VALIDATED_SCHEMA)
    found = validated.agg(F.count(F.lit(1))).scalar()
    return validated.select(
        *VALIDATED_COLUMNS, F.lit(True).alias("collision_found"), found.alias("collision_count")
    ).orderBy(*_IN_ORDER)


def _objects(validated: DataFrame) -> DataFrame:
    """Each collision as one JSON object; nulls stay, times are ``yyyy-MM-dd HH:mm:ss``."""
    values = [
        time_text(F.col(name)).alias(name) if name == "collision_time" else F.col(name)
        for name in VALIDATED_COLUMNS
    ]
    whole = F.struct(*values, F.lit(True).alias("collision_found"))
    return validated.select(*_IN_ORDER, F.to_json(whole, _KEEP_NULLS).alias("object"))


def collision_document(validated: DataFrame) -> DataFrame:
    """The result document as ordered text lines (column ``value``).

    None found: ``{"collision_found":false}``. One: its object. More: an object with
    ``collision_found``, ``collision_count`` and the list ``collisions`` in order of time. The list
    has one line per collision, so a long document is sorted and written in parallel; its part files
    concatenate to the document.
    """
    expect(validated, VALIDATED_SCHEMA)
    summary = validated.agg(F.count(F.lit(1)).alias("found"), F.min(F.struct(*_IN_ORDER)).alias("first"))
    found, first = summary.select("found").scalar(), summary.select("first").scalar()
    no_key = [F.lit(None).cast(CANDIDATE_SCHEMA[name].dataType).alias(name) for name in _IN_ORDER]
    opening = F.when(F.col("found") == 0, F.lit(_NO_COLLISION)).when(
        F.col("found") > 1,
        F.format_string('{"collision_found":true,"collision_count":%d,"collisions":[', F.col("found")),
    )
    closing = F.when(F.col("found") > 1, F.lit("]}"))
    heads = summary.select(F.lit(0).alias("part"), *no_key, opening.alias("value"))
    tails = summary.select(F.lit(2).alias("part"), *no_key, closing.alias("value"))
    leads_on = (found > 1) & (F.struct(*_IN_ORDER) != first)
    body = _objects(validated).select(
        F.lit(1).alias("part"),
        *_IN_ORDER,
        F.concat(F.when(leads_on, F.lit(",")).otherwise(F.lit("")), F.col("object")).alias("value"),
    )
    lines = heads.unionByName(body).unionByName(tails).filter(F.col("value").isNotNull())
    return lines.orderBy("part", *_IN_ORDER).select("value")


def trajectory_points(
    candidates: DataFrame, tracks: DataFrame, rules: BehaviourRules = BehaviourRules()
) -> DataFrame:
    """Both vessels' positions in [t - w, t + w], for every candidate (or validated collision)."""
    window = rules.window_minutes * 60
    return reports_around(candidate_sides(candidates), tracks, window, window, ["latitude", "longitude", "name"]).select(
        "candidate_id", "vessel_side", "mmsi", "timestamp", "latitude", "longitude", "name"
    )


def path_pieces(candidates: DataFrame, tracks: DataFrame, rules: BehaviourRules = BehaviourRules()) -> DataFrame:
    """The trajectories in pieces of an hour: candidate_id, vessel_side, mmsi, piece (its number, growing with time) and its points in order.

    However long the window, a row holds at most one point per second of an hour.
    """
    piece = F.floor(epoch_seconds(F.col("timestamp")) / PIECE_SECONDS).alias("piece")
    points = F.array_sort(F.collect_list(F.struct("timestamp", "latitude", "longitude"))).alias("points")
    return trajectory_points(candidates, tracks, rules).groupBy(*_PATH, piece).agg(points)


def paths_of(candidates: DataFrame, pieces: DataFrame) -> DataFrame:
    """One row per candidate and side of ``path_pieces``: label, number of points, first and last point."""
    names = candidates.select(
        "candidate_id",
        F.inline(
            F.array(
                *(
                    F.struct(
                        F.lit(side).alias("vessel_side"),
                        F.format_string("%s (%s)", F.col(f"name_{side}"), F.col(f"mmsi_{side}")).alias("label"),
                    )
                    for side in SIDES
                )
            )
        ),
    )
    ends = (("start", 1, F.min_by), ("end", -1, F.max_by))
    fields = (("ts", "timestamp"), ("latitude", "latitude"), ("longitude", "longitude"))
    paths = pieces.groupBy(*_PATH).agg(
        F.sum(F.size("points")).cast("bigint").alias("n_points"),
        *(at(F.element_at("points", place)[field], "piece").alias(f"{end}_{name}") for end, place, at in ends for name, field in fields),
    )
    return paths.join(names, ["candidate_id", "vessel_side"]).select(
        *_PATH, "label", "n_points", *(f"{end}_{name}" for end, _, _ in ends for name, _ in fields)
    )


def trajectory_paths(
    candidates: DataFrame, tracks: DataFrame, rules: BehaviourRules = BehaviourRules()
) -> DataFrame:
    """``paths_of`` the pieces that ``path_pieces`` finds."""
    return paths_of(candidates, path_pieces(candidates, tracks, rules))


def feature_parts(candidates: DataFrame, pieces: DataFrame) -> DataFrame:
    """Each path as the parts of one GeoJSON ``Feature`` (column ``value``): its beginning, each piece's coordinates, its end.

    Put together in order of (candidate_id, vessel_side, part, piece) the values of a path are a LineString, or a Point if it has one fix.
    """
    paths = paths_of(candidates, pieces)
    properties = F.to_json(
        F.struct(
            *_PATH,
            "label",
            "n_points",
            time_text(F.col("start_ts")).alias("start"),
            time_text(F.col("end_ts")).alias("end"),
        ),
        _KEEP_NULLS,
    )
    line = F.col("n_points") > 1
    opening = F.format_string(
        '{"type":"Feature","properties":%s,"geometry":{"type":"%s","coordinates":%s',
        properties,
        F.when(line, F.lit("LineString")).otherwise(F.lit("Point")),
        F.when(line, F.lit("[")).otherwise(F.lit("")),
    )
    closing = F.when(line, F.lit("]}}")).otherwise(F.lit("}}"))
    coordinates = F.to_json(F.transform("points", lambda point: F.array(point["longitude"], point["latitude"])))
    first = F.floor(epoch_seconds(F.col("start_ts")) / PIECE_SECONDS)
    inner = F.substring(coordinates, F.lit(2), F.length(coordinates) - 2)
    body = pieces.join(paths.select("candidate_id", "vessel_side", "start_ts"), ["candidate_id", "vessel_side"]).select(
        "candidate_id",
        "vessel_side",
        F.lit(1).alias("part"),
        "piece",
        F.concat(F.when(F.col("piece") > first, F.lit(",")).otherwise(F.lit("")), inner).alias("value"),
    )
    edges = F.array(*(F.struct(F.lit(part).alias("part"), value.alias("value")) for part, value in ((0, opening), (2, closing))))
    frame = paths.select("candidate_id", "vessel_side", F.inline(edges)).withColumn("piece", F.lit(None).cast("bigint"))
    return body.unionByName(frame)
