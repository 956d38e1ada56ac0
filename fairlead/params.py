"""Thresholds of every operator, as frozen dataclasses.

The numbers below are fixed values: they are the published defaults, and results only match with
these. Everything is a parameter, so another sea area or another rule set is a constructor call.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from fairlead.functions.identity import ALLOCATED_MIDS, BLOCKED_MMSI


@dataclass(frozen=True)
class Circle:
    """A sea area: every position within ``radius_nm`` of a centre."""

    latitude: float = 55.225
    longitude: float = 14.245
    radius_nm: float = 50.0

    def __post_init__(self) -> None:
        if not (-90 <= self.latitude <= 90 and -180 <= self.longitude <= 180):
            raise ValueError(f"centre outside the globe: {self.latitude}, {self.longitude}")
        if self.radius_nm <= 0:
            raise ValueError("radius_nm must be positive")


@dataclass(frozen=True)
class ReportRules:
    """Which raw reports survive cleaning. ``area=None`` keeps the whole globe."""

    area: Circle | None = field(default_factory=lambda: Circle(radius_nm=75.0))
    blocked_mmsi: tuple[str, ...] = BLOCKED_MMSI
    allocated_mids: tuple[str, ...] = ALLOCATED_MIDS


@dataclass(frozen=True)
class JumpRules:
    """Implied-speed limits of the GPS jump filter.

    ``edge_mode="strict"`` evaluates the two spike tests in SQL's three-valued logic and drops rows
    whose test is unknown, so a first or last point is already dropped above ``speed_knots`` and a
    lone point always. ``edge_mode="limit"`` reads unknown as "not a spike": edges are dropped above
    ``edge_speed_knots`` only and lone points stay.

    ``segment_seconds`` is the length of the time slices a vessel's track is split into, so that no
    task holds a whole track. It changes the plan, never the result.
    """

    speed_knots: float = 60.0
    edge_speed_knots: float = 200.0
    edge_mode: str = "strict"
    segment_seconds: int = 86_400

    def __post_init__(self) -> None:
        if self.edge_mode not in ("strict", "limit"):
            raise ValueError(f"unknown edge_mode {self.edge_mode!r}")
        if self.segment_seconds < 1:
            raise ValueError("segment_seconds must be at least 1")


@dataclass(frozen=True)
class ProximityRules:
    """What counts as an encounter, and how the join that finds it is cut into cells.

    ``cell_degrees`` (height of a grid row), ``bucket_seconds`` and ``split_rows`` shape the plan
    only. Cells left at ``None`` follow from the limits: four times the distance limit and twice the
    time limit, which replicates a report about 3.4 times instead of the 27 of a full neighbourhood.
    ``split_rows`` is the number of reports, or of visits by reports near it, above which one cell is divided between tasks.
    Up to ``broadcast_visits`` visits in all, Spark may broadcast the side of the join that holds them.

    ``per="pair"`` keeps one closest approach per vessel pair. ``per="encounter"`` keeps one per encounter: meetings of a pair
    with no more than ``encounter_gap_seconds`` between them, counted in slots of ten seconds.
    """

    distance_nm: float = 0.05
    gap_seconds: int = 60
    cell_degrees: float | None = None
    bucket_seconds: int | None = None
    split_rows: int = 4096
    broadcast_visits: int = 200_000
    per: str = "pair"
    encounter_gap_seconds: int = 3600

    def __post_init__(self) -> None:
        if self.per not in ("pair", "encounter"):
            raise ValueError(f"unknown per {self.per!r}")
        if self.distance_nm <= 0 or self.gap_seconds < 0:
            raise ValueError("distance_nm must be positive and gap_seconds not negative")
        if self.cell_degrees is not None and not 0 < self.cell_degrees <= 90:
            raise ValueError("cell_degrees must lie in (0, 90]")
        if self.bucket_seconds is not None and self.bucket_seconds < 1:
            raise ValueError("bucket_seconds must be at least 1")
        if self.split_rows < 1:
            raise ValueError("split_rows must be at least 1")


@dataclass(frozen=True)
class BehaviourRules:
    """Length of the windows before and after an encounter, in minutes."""

    window_minutes: int = 10

    def __post_init__(self) -> None:
        if self.window_minutes < 1:
            raise ValueError("window_minutes must be at least 1")


@dataclass(frozen=True)
class CollisionRules:
    """When a scored encounter counts as a collision."""

    moving_knots: float = 1.0
    stationary_knots: float = 0.5
    moving_metres: float = 100.0
    stationary_metres: float = 50.0
    min_points: int = 3
    collision_metres: float = 5.0
    min_speed_drop: float = 0.2
    collision_min_points: int = 20
    collision_moved_metres: float = 1000.0
    collision_approach_metres: float = 1000.0
    excluded_types: tuple[str, ...] = ("Pilot",)


@dataclass(frozen=True)
class Rules:
    """All parameters of one pipeline run."""

    reports: ReportRules = field(default_factory=ReportRules)
    jumps: JumpRules = field(default_factory=JumpRules)
    area: Circle = field(default_factory=Circle)
    proximity: ProximityRules = field(default_factory=ProximityRules)
    behaviour: BehaviourRules = field(default_factory=BehaviourRules)
    collisions: CollisionRules = field(default_factory=CollisionRules)
