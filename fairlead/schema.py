"""Table layouts, and the check operators run on their input."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Column names of a raw report file.
RAW_TIME = "# Timestamp"
RAW_COLUMNS = (
    RAW_TIME, "MMSI", "Latitude", "Longitude", "Navigational status", "SOG", "COG", "Heading",
    "Name", "Ship type", "Width", "Length", "Draught",
)


def _fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in pairs])


# The day of a stored position, by which its table is laid out.
DAY = "event_date"
# The first and last day of the folder that a stored track position lies in.
FIRST_DAY, LAST_DAY = "first_day", "last_day"
# The hour of a stored track position, counted from the epoch: with the vessel, what tracks are bucketed by.
HOUR = "track_hour"
HOUR_SECONDS = 3600

_STRING, _DOUBLE, _LONG = T.StringType(), T.DoubleType(), T.LongType()
_BOOLEAN, _TIME = T.BooleanType(), T.TimestampNTZType()

RAW_SCHEMA = _fields(*((name, _STRING) for name in RAW_COLUMNS))

POSITION_SCHEMA = _fields(
    ("mmsi", _STRING),
    ("timestamp", _TIME),
    ("latitude", _DOUBLE),
    ("longitude", _DOUBLE),
    ("navigational_status", _STRING),
    ("sog", _DOUBLE),
    ("cog", _DOUBLE),
    ("heading", _DOUBLE),
    ("name", _STRING),
    ("ship_type", _STRING),
    ("width", _DOUBLE),
    ("length", _DOUBLE),
    ("draught", _DOUBLE),
)
POSITION_COLUMNS = tuple(POSITION_SCHEMA.names)

CANDIDATE_SCHEMA = _fields(
    ("candidate_id", _STRING),
    ("mmsi_1", _STRING),
    ("mmsi_2", _STRING),
    ("name_1", _STRING),
    ("name_2", _STRING),
    ("collision_time", _TIME),
    ("collision_latitude", _DOUBLE),
    ("collision_longitude", _DOUBLE),
    ("minimum_distance_nm", _DOUBLE),
)
CANDIDATE_COLUMNS = tuple(CANDIDATE_SCHEMA.names)

SIDE_SCHEMA = _fields(
    ("candidate_id", _STRING), ("collision_time", _TIME), ("vessel_side", _STRING), ("mmsi", _STRING)
)

BEFORE_FIELDS = (
    ("before_point_count", _LONG),
    ("before_median_sog", _DOUBLE),
    ("before_moved_meters", _DOUBLE),
    ("first_latitude", _DOUBLE),
    ("first_longitude", _DOUBLE),
    ("last_latitude", _DOUBLE),
    ("last_longitude", _DOUBLE),
)
AFTER_FIELDS = (("after_point_count", _LONG), ("after_median_sog", _DOUBLE))

SIDES = ("1", "2")


def _both(*pairs: tuple[str, T.DataType]) -> list[tuple[str, T.DataType]]:
    return [(f"vessel_{side}_{name}", kind) for name, kind in pairs for side in SIDES]


VALIDATED_SCHEMA = _fields(
    *((field.name, field.dataType) for field in CANDIDATE_SCHEMA),
    *_both(("ship_type", _STRING)),
    *((f"vessel_{side}_{name}", kind) for side in SIDES for name, kind in BEFORE_FIELDS),
    *((f"vessel_{side}_{name}", kind) for side in SIDES for name, kind in AFTER_FIELDS),
    *_both(("was_moving", _BOOLEAN)),
    ("both_were_stationary", _BOOLEAN),
    *_both(("after_speed", _DOUBLE), ("speed_drop_pct", _DOUBLE)),
    ("combined_speed_drop_pct", _DOUBLE),
    ("pre_event_pair_distance_meters", _DOUBLE),
    ("minimum_distance_meters", _DOUBLE),
    ("approach_distance_meters", _DOUBLE),
    ("vessels_approached", _BOOLEAN),
    *_both(("is_excluded_type", _BOOLEAN)),
)
VALIDATED_COLUMNS = tuple(VALIDATED_SCHEMA.names)


def expect(df: DataFrame, layout: T.StructType, columns: Iterable[str] | None = None) -> DataFrame:
    """Fail early, with names, if ``df`` lacks a column of ``layout`` or has it in another type."""
    wanted = {field.name: field.dataType for field in layout}
    present = {field.name: field.dataType for field in df.schema}
    wrong = [
        f"{name}: expected {wanted[name].simpleString()}, "
        f"found {present[name].simpleString() if name in present else 'no such column'}"
        for name in (columns or wanted)
        if present.get(name) != wanted[name]
    ]
    if wrong:
        raise ValueError("unexpected table layout: " + "; ".join(wrong))
    return df
