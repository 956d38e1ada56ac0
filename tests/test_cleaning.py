from __future__ import annotations

import math

import pytest
from helpers import report, reports

from fairlead.operators.area import within_area
from fairlead.operators.cleaning import clean_reports, type_reports
from fairlead.params import Circle, ReportRules
from fairlead.schema import POSITION_SCHEMA

GLOBE = ReportRules(area=None)


def test_types_and_trimming(spark):
    raw = reports(spark, [report(MMSI=" 219000001 ", Name=" A B ", **{"Ship type": " Cargo", "Navigational status": "Moored "})])
    cleaned = clean_reports(raw, GLOBE)
    assert [(f.name, f.dataType) for f in cleaned.schema] == [(f.name, f.dataType) for f in POSITION_SCHEMA]
    row = cleaned.first()
    assert (row.mmsi, row.name, row.ship_type, row.navigational_status) == ("219000001", "A B", "Cargo", "Moored")
    assert str(row.timestamp) == "2021-12-13 02:00:00"


def test_text_that_is_no_number_becomes_null(spark):
    texts = ["1.5", " 1.5 ", "", "abc", None, "NaN"]
    rows = type_reports(reports(spark, [report(SOG=text) for text in texts])).collect()
    values = [row.sog for row in rows]
    assert values[:5] == [1.5, 1.5, None, None, None]
    assert math.isnan(values[5])


@pytest.mark.parametrize(
    "lat, lon, kept",
    [
        ("90", "0", True),
        ("-90", "180", True),
        ("0", "-180", True),
        ("90.0001", "0", False),
        ("0", "180.0001", False),
        ("0", "-180.0001", False),
        ("", "0", False),
        ("abc", "0", False),
        ("NaN", "0", False),
        ("0", "NaN", False),
        (None, "0", False),
    ],
)
def test_positions_on_the_globe(spark, lat, lon, kept):
    assert clean_reports(reports(spark, [report(Latitude=lat, Longitude=lon)]), GLOBE).count() == kept


def test_rows_without_time_or_identity_go(spark):
    bad = [report(**{"# Timestamp": "soon"}), report(MMSI="123456789"), report(MMSI="555555555"), report(MMSI="999000000")]
    assert clean_reports(reports(spark, [report(), *bad]), GLOBE).count() == 1


def test_default_area_is_the_wide_circle(spark):
    rows = [report(Latitude=str(55.225 + miles / 60.04), Longitude="14.245") for miles in (0, 74.9, 75.1, 200)]
    assert clean_reports(reports(spark, rows)).count() == 2
    assert clean_reports(reports(spark, rows), GLOBE).count() == 4


def test_lists_are_parameters(spark):
    rules = ReportRules(area=None, blocked_mmsi=("219000001",), allocated_mids=("219", "999"))
    rows = [report(), report(MMSI="999000001"), report(MMSI="230000001")]
    assert [row.mmsi for row in clean_reports(reports(spark, rows), rules).collect()] == ["999000001"]


def test_missing_column_fails_by_name(spark):
    with pytest.raises(ValueError, match="Draught: expected string, found no such column"):
        clean_reports(reports(spark, [report()]).drop("Draught"))


def test_area_across_the_date_line(spark):
    rows = [report(Latitude="0", Longitude=text) for text in ("179.9", "-179.9", "179", "-179")]
    positions = clean_reports(reports(spark, rows), GLOBE)
    found = within_area(positions, Circle(0.0, 179.95, 20.0)).collect()
    assert sorted(row.longitude for row in found) == [-179.9, 179.9]
