"""Raw text reports -> typed positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.functions.clock import parse_report_time
from fairlead.functions.identity import mmsi_usable
from fairlead.operators.area import inside
from fairlead.params import ReportRules
from fairlead.schema import RAW_COLUMNS, RAW_SCHEMA, RAW_TIME, expect


def _text(name: str) -> Column:
    return F.trim(F.col(f"`{name}`"))


def _number(name: str) -> Column:
    # try_cast: text that is no number becomes null instead of failing the job.
    return F.col(f"`{name}`").try_cast("double")


def _keys() -> dict[str, Column]:
    return {
        "mmsi": _text("MMSI"),
        "timestamp": parse_report_time(F.col(f"`{RAW_TIME}`")),
        "latitude": _number("Latitude"),
        "longitude": _number("Longitude"),
    }


def _details() -> dict[str, Column]:
    return {
        "navigational_status": _text("Navigational status"),
        "sog": _number("SOG"),
        "cog": _number("COG"),
        "heading": _number("Heading"),
        "name": _text("Name"),
        "ship_type": _text("Ship type"),
        "width": _number("Width"),
        "length": _number("Length"),
        "draught": _number("Draught"),
    }


def _named(columns: dict[str, Column]) -> list[Column]:
    return [column.alias(name) for name, column in columns.items()]


def type_reports(raw: DataFrame) -> DataFrame:
    """The thirteen position columns, parsed and trimmed; nothing is dropped."""
    return expect(raw, RAW_SCHEMA).select(*_named(_keys() | _details()))


def clean_reports(raw: DataFrame, rules: ReportRules = ReportRules()) -> DataFrame:
    """Typed reports with a usable identity, a time and a position on the globe and in the area.

    A narrow operator, without a shuffle. The four columns the tests need are parsed once, the
    others only for rows that pass.
    """
    # Generated rather than selected: Spark would copy a selected expression into every test that
    # names it, and parse each text again for each.
    parsed = expect(raw, RAW_SCHEMA).select(
        *(f"`{name}`" for name in RAW_COLUMNS if name not in (RAW_TIME, "MMSI", "Latitude", "Longitude")),
        F.inline(F.array(F.struct(*_named(_keys())))),
    )
    passing = (
        parsed.filter(mmsi_usable("mmsi", rules.blocked_mmsi, rules.allocated_mids))
        .filter(F.col("timestamp").isNotNull())
        .filter(F.col("latitude").between(-90.0, 90.0) & F.col("longitude").between(-180.0, 180.0))
    )
    if rules.area is not None:
        passing = passing.filter(inside(rules.area))
    return passing.select(*_keys(), *_named(_details()))
