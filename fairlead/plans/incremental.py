"""Encounters of a position table that grows: days that changed are worked on again, with their borders, and no others.

Four tables by day stand between positions and candidates: the ends of each vessel's day, the tracks, the slots in which vessels
met, and the nearest slot of each pair with its candidate. Each day of a table notes what it was made from. A day is redone if that
has changed, so a run that broke off is taken up by the next one. Everything is written by ``DayTable.replace``:
readers see a day before or after.

What a day depends on: its tracks on the vessels' last fixes before and first fixes after it, on whatever days those lie; its
meetings on the tracks of the day and of the border minutes beside it; its candidates on the slots of all days, which are one
number each, and on the tracks around them.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlead.functions.clock import epoch_seconds
from fairlead.operators.area import within_area
from fairlead.operators.collisions import score_candidates, validate_candidates
from fairlead.operators.jumps import SEGMENT, believable, neighbour_speeds, segment_ends, segment_links, unique_positions, with_segment
from fairlead.operators.proximity import closest_approach, crowded_cells, meeting_slots, nearest_of, pinpoint, slot_day
from fairlead.params import Rules
from fairlead.plans.pipeline import Encounters
from fairlead.schema import CANDIDATE_SCHEMA, DAY, POSITION_COLUMNS, POSITION_SCHEMA
from fairlead.sources.daytable import DayTable
from fairlead.sources.tables import Staging, with_day

_DAY_SECONDS = 86_400
_FIX = T.StructType([f for f in POSITION_SCHEMA if f.name in ("timestamp", "latitude", "longitude")])
_DATED = T.StructField(DAY, T.DateType())


def _layout(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields]).add(_DATED)


_ENDS = _layout(("mmsi", T.StringType()), (SEGMENT, T.LongType()), ("head", _FIX), ("tail", _FIX))
_TRACKS = T.StructType([*POSITION_SCHEMA, _DATED])
_SLOTS = _layout(("mmsi_1", T.StringType()), ("mmsi_2", T.StringType()), ("slot", T.LongType()), ("distance_nm", T.DoubleType()))
_CANDIDATES = T.StructType([*CANDIDATE_SCHEMA, T.StructField("slot", T.LongType()), T.StructField("distance_nm", T.DoubleType()), _DATED])


def _days(frame: DataFrame) -> set[str]:
    """The days of a table as text: their names, not its rows, reach the driver."""
    return {str(row[0]) for row in frame.select(DAY).distinct().toLocalIterator()}


def _around(days: Iterable[str]) -> set[str]:
    return {str(date.fromisoformat(day) + timedelta(step)) for day in days for step in (-1, 0, 1)}


class Store:
    """The tables of a run under ``folder``; ``redone`` tells which days of each the last update wrote."""

    def __init__(self, spark: SparkSession, positions: str, folder: str, rules: Rules = Rules()) -> None:
        if rules.jumps.segment_seconds != _DAY_SECONDS:
            raise ValueError("incremental tracks are cut by day: segment_seconds must be 86400")
        if rules.proximity.gap_seconds > _DAY_SECONDS:
            raise ValueError("meetings reach into the days beside theirs only: gap_seconds must not exceed 86400")
        self.spark, self.rules = spark, rules
        self.positions = DayTable(spark, positions)
        self.ends, self.tracks, self.slots, self.candidates = (
            DayTable(spark, f"{folder.rstrip('/')}/{name}") for name in ("ends", "tracks", "slots", "candidates")
        )
        self.redone: dict[str, list[str]] = {}

    def update(self) -> None:
        """Brings all tables up to date with the position table."""
        staging = Staging(self.spark)
        self._update_tracks(staging)
        self._update_slots(staging)
        self._update_candidates(staging)
        staging.remove()

    def _read_positions(self, days: Iterable[str]) -> DataFrame:
        return self.positions.read(POSITION_SCHEMA, days=days)

    def _update_tracks(self, staging: Staging) -> None:
        now = {day: sorted(batches) for day, batches in self.positions.batches().items()}
        made = self.ends.sources()
        dirty = sorted(day for day in now.keys() | made.keys() if now.get(day, []) != made.get(day, []))
        self.redone["ends"] = self.redone["tracks"] = dirty
        if not dirty:
            return
        unique = staging.keep(unique_positions(self._read_positions(dirty)), "unique")
        fresh = staging.keep(with_day(segment_ends(with_segment(unique)).withColumn("timestamp", F.col("head.timestamp"))).drop("timestamp"), "ends")
        before = self.ends.read(_ENDS)
        others = before.filter(~F.col(DAY).cast("string").isin(dirty))
        ends = others.unionByName(fresh)
        # A day's rows change if the fix before or after them does: days beside a dirty one on some vessel's track, as it was or as it is.
        touched = [
            segment_links(table).join(moved.select("mmsi").distinct(), "mmsi", "left_semi").select("mmsi", SEGMENT, "tail_before", "head_after")
            for table, moved in ((before, before.filter(F.col(DAY).cast("string").isin(dirty))), (ends, fresh))
        ]
        near = (F.to_date(F.col(f"{own}.timestamp")).cast("string").isin(dirty) for own in ("tail_before", "head_after"))
        beside = reduce(DataFrame.unionByName, touched).filter(reduce(Column.__or__, near))
        # One job: only days leave it.
        redo = set(dirty) | _days(beside.select(F.date_from_unix_date(F.col(SEGMENT).cast("int")).alias(DAY)))
        borders = sorted(redo - set(dirty))
        rows = unique.unionByName(unique_positions(self._read_positions(borders))) if borders else unique
        speeds = neighbour_speeds(rows, links=segment_links(ends))
        tracks = with_day(speeds.filter(believable(self.rules.jumps)).select(*POSITION_COLUMNS))
        self.redone["tracks"] = sorted(redo)
        self.tracks.replace(tracks, redo, by="mmsi")
        # Last: until the ends know the new batches, these days count as changed. One file a day, of one row a vessel.
        self.ends.replace(fresh, dirty, sources={day: now.get(day, []) for day in dirty})

    def _update_slots(self, staging: Staging) -> None:
        shown = self.tracks.visible()
        made = self.slots.sources()

        def source(day: str) -> list[str]:
            return sorted(f"{near} {name}" for near in _around([day]) for name in shown.get(near, ()))

        dirty = sorted(day for day in shown.keys() | made.keys() if source(day) != made.get(day, []))
        self.redone["slots"] = dirty
        if not dirty:
            return
        gap, second = self.rules.proximity.gap_seconds, epoch_seconds(F.col("timestamp"))
        tracks = self.tracks.read(_TRACKS, days=_around(dirty))
        reached = (F.date_from_unix_date(F.floor((second + step) / _DAY_SECONDS).cast("int")) for step in (-gap, 0, gap))
        near = tracks.filter(reduce(Column.__or__, (day.cast("string").isin(dirty) for day in reached)))
        inside = within_area(near, self.rules.area).select("mmsi", "timestamp", "latitude", "longitude", "name")
        points = staging.keep(inside, "area")
        seen = Observation("visits of cells")
        crowded = staging.keep(crowded_cells(points, self.rules.proximity, seen), "crowded")
        met = meeting_slots(points, self.rules.proximity, crowded, seen.get.get("visits", 0))
        self.slots.replace(met.withColumn(DAY, slot_day(F.col("slot"))), dirty, sources={day: source(day) for day in dirty})

    def _update_candidates(self, staging: Staging) -> None:
        shown = self.slots.visible()
        made = self.candidates.sources()
        nearest = nearest_of(self.slots.read(_SLOTS), self.rules.proximity).withColumn(DAY, slot_day(F.col("slot")))
        nearest = staging.keep(nearest, "nearest")
        # A pair's nearest slot may have moved to or from a day whose own slots are as before.
        key = ["mmsi_1", "mmsi_2", "slot", "distance_nm", DAY]
        known = self.candidates.read(_CANDIDATES)
        moved = [one.select(key).join(other.select(key), key, "left_anti") for one, other in ((nearest, known), (known, nearest))]
        dirty = {day for day in shown.keys() | made.keys() if sorted(shown.get(day, ())) != made.get(day, [])}
        dirty = sorted(dirty.union(*map(_days, moved)))
        self.redone["candidates"] = dirty
        if not dirty:
            return
        wanted = nearest.filter(F.col(DAY).cast("string").isin(dirty))
        points = within_area(self.tracks.read(_TRACKS, days=_around(dirty)), self.rules.area)
        own = [name for name in wanted.columns if name not in ("slot", "distance_nm", DAY)]
        found = closest_approach(pinpoint(wanted.drop(DAY), points, self.rules.proximity), keep=own)
        dated = found.join(wanted, own).select(*_CANDIDATES.names)
        self.candidates.replace(dated, dirty, sources={day: sorted(shown.get(day, ())) for day in dirty})

    def encounters(self, staging: Staging) -> Encounters:
        """Tracks and candidates as they stand, with scores and collisions. Types and scores may change with any new
        report of a vessel, so all candidates are scored; of the tracks that reads the days around them and every report's type."""
        tracks, rules = self.tracks.read(_TRACKS), self.rules
        candidates = self.candidates.read(_CANDIDATES).select(*CANDIDATE_SCHEMA.names)
        scored = staging.keep(score_candidates(candidates, tracks, rules.behaviour, rules.collisions), "scored")
        validated = staging.keep(validate_candidates(scored, rules.collisions), "validated")
        return Encounters(tracks, candidates, scored, validated)
