"""Vessel pairs that came close in space and time.

The join is an equi-join on (time bucket, grid row, grid cell). Each report sits in one home cell.
It looks for partners in the cells its own reach touches, backwards in time only, so every pair of
reports meets exactly once. Grid rows nearer a pole hold fewer cells, which keeps a cell's real width
constant, and cells wrap at 180 degrees.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from fairlead.functions.clock import epoch_seconds, from_epoch
from fairlead.functions.geo import haversine_nm, latitude_reach, longitude_reach
from fairlead.params import ProximityRules
from fairlead.schema import CANDIDATE_COLUMNS, POSITION_SCHEMA, expect

CELL = ("time_bucket", "lat_cell", "lon_cell")
_PART = ("early_part", "late_part")

# Length of the time slots in which ``nearest_slots`` notes a pair's least distance. Short: the reports
# of a slot are compared once more. Not too short: a pair has one number per slot.
_SLOT_SECONDS = 10
_ENCOUNTER = "encounter"

# The bitmap of crowded cells has 2**22 bits in words of 64: at most 65,536 rows, however many cells are crowded.
_BITMAP_BITS = 22
# Tasks that share the reports of one crowded cell while they learn its parts, and the rows of a cell up to which one task is enough.
_SALTS = 16
_UNSALTED_ROWS = 65_536


def _cell_degrees(rules: ProximityRules) -> float:
    return rules.cell_degrees or min(4 * latitude_reach(rules.distance_nm), 90.0)


def _bucket_seconds(rules: ProximityRules) -> int:
    return rules.bucket_seconds or max(2 * rules.gap_seconds, 1)


def _cells_in_row(lat_cell: Column, height: float) -> Column:
    """How many cells a grid row is cut into; a cell is at least as wide as it is high."""
    poleward = F.greatest(F.abs(lat_cell * F.lit(height)), F.abs((lat_cell + 1) * F.lit(height)))
    fitting = F.floor(F.lit(360.0 / height) * F.cos(F.radians(F.least(poleward, F.lit(90.0)))))
    return F.greatest(fitting, F.lit(1).cast("bigint"))


def _column_of(longitude: Column, cells: Column) -> Column:
    return F.floor((longitude + F.lit(180.0)) * cells / F.lit(360.0))


def home_cells(points: DataFrame, rules: ProximityRules = ProximityRules()) -> DataFrame:
    """Adds the one cell each report lies in."""
    height, bucket = _cell_degrees(rules), _bucket_seconds(rules)
    return (
        points.withColumn("time_bucket", F.floor(epoch_seconds(F.col("timestamp")) / bucket))
        .withColumn("lat_cell", F.floor(F.col("latitude") / F.lit(height)))
        .withColumn("row_cells", _cells_in_row(F.col("lat_cell"), height))
        .withColumn("lon_cell", F.pmod(_column_of(F.col("longitude"), F.col("row_cells")), F.col("row_cells")))
        .drop("row_cells")
    )


def reached_cells(points: DataFrame, rules: ProximityRules = ProximityRules()) -> DataFrame:
    """One row per report and cell that may hold an earlier report within both limits."""
    height, bucket = _cell_degrees(rules), _bucket_seconds(rules)
    seconds = epoch_seconds(F.col("timestamp"))
    up = F.lit(latitude_reach(rules.distance_nm))
    across = longitude_reach(F.col("latitude"), rules.distance_nm)
    first = _column_of(F.col("longitude") - across, F.col("row_cells"))
    last = _column_of(F.col("longitude") + across, F.col("row_cells"))
    return (
        points.withColumn(
            "time_bucket",
            F.explode(F.sequence(F.floor((seconds - rules.gap_seconds) / bucket), F.floor(seconds / bucket))),
        )
        .withColumn(
            "lat_cell",
            F.explode(
                F.sequence(
                    F.floor((F.col("latitude") - up) / F.lit(height)),
                    F.floor((F.col("latitude") + up) / F.lit(height)),
                )
            ),
        )
        .withColumn("row_cells", _cells_in_row(F.col("lat_cell"), height))
        # Near a pole the reach may go round the whole row: no cell twice.
        .withColumn("lon_cell", F.explode(F.sequence(first, F.least(last, first + F.col("row_cells") - 1))))
        .withColumn("lon_cell", F.pmod(F.col("lon_cell"), F.col("row_cells")))
        .drop("row_cells")
    )


def crowded_cells(
    points: DataFrame, rules: ProximityRules = ProximityRules(), seen: Observation | None = None
) -> DataFrame:
    """Cells that more than ``split_rows`` reports lie in or look into, and into how many parts to divide either side.

    The count is pre-aggregated in each map task and reads three columns. The result has at most a few
    rows per ``split_rows`` reports; write it out before the join, so that Spark knows its size. ``seen`` notes
    how many ``visits`` there are: the rows of the replicated side of the join.
    """
    fixes = points.select("timestamp", "latitude", "longitude")
    lying = home_cells(fixes, rules).select(*CELL, F.lit(True).alias("home"))
    looking = reached_cells(fixes, rules).select(*CELL, F.lit(False).alias("home"))
    if seen is not None:
        looking = looking.observe(seen, F.count(F.lit(1)).alias("visits"))
    counts = lying.unionByName(looking).groupBy(*CELL)
    both = counts.agg(F.count(F.when(F.col("home"), 1)).alias("reports"), F.count(F.when(~F.col("home"), 1)).alias("visits"))
    crowded = both.filter((F.least("reports", "visits") > 0) & (F.greatest("reports", "visits") > rules.split_rows))
    return crowded.select(
        *CELL,
        *(
            F.ceil(F.col(rows) / F.lit(rules.split_rows)).cast("int").alias(f"{part}s")
            for rows, part in zip(("reports", "visits"), _PART)
        ),
    )


def _bit_of_cell() -> tuple[Column, Column]:
    """The word of the bitmap that a cell falls in, and its bit there."""
    slot = F.pmod(F.xxhash64(*CELL), F.lit(1 << _BITMAP_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(slot, F.lit(64)).cast("int"))
    return F.shiftright(slot, 6), bit


def _parted(met: DataFrame, own: str, other: str) -> DataFrame:
    """Rows that know their cell's parts, with a part of their own side, once for each part of the other."""
    mine = F.pmod(F.hash("mmsi", "timestamp"), F.coalesce(f"{own}s", F.lit(1)))
    theirs = F.explode(F.sequence(F.lit(0), F.coalesce(f"{other}s", F.lit(1)) - 1))
    return met.withColumn(own, mine).withColumn(other, theirs)


def _divide(cells: DataFrame, crowded: DataFrame, stored: bool, split_rows: int, own: str, other: str) -> DataFrame:
    """Spread the reports of a crowded cell over ``early_parts`` x ``late_parts`` sub-keys.

    A report takes one part of its own side and visits every part of the other, so each pair of
    reports still meets under exactly one key and no task gets the product of a crowded cell's sides.

    Which reports may lie in a crowded cell is told by a bitmap, broadcast because its size is bounded. The others get their key in
    the scan; only those few meet the crowded cells, by cell and salt, so that not even this join gathers a cell. It is merged: Spark
    knows the stored cells' size, not how often the salts repeat them, and would send them through the driver. A second bitmap tells the
    few cells that need salts.
    Cells that are not stored would be counted for the bitmap and again for the join; they are joined as they are.
    """
    columns = [*cells.columns, own, other]
    if not stored:
        return _parted(cells.join(crowded, list(CELL), "left"), own, other).select(*columns)
    word, bit = _bit_of_cell()
    full = F.greatest(*(F.col(f"{part}s") for part in _PART)).cast("bigint") * split_rows > _UNSALTED_ROWS
    bits = crowded.select(word.alias("word"), bit.alias("bit"), F.when(full, bit).otherwise(F.lit(0)).alias("full"))
    bitmap = bits.groupBy("word").agg(F.bit_or("bit").alias("bits"), F.bit_or("full").alias("full_bits"))
    marked = cells.withColumn("word", word).join(F.broadcast(bitmap), "word", "left")
    may = F.coalesce(F.col("bits").bitwiseAND(bit) != 0, F.lit(False))
    plain = marked.filter(~may).select(*cells.columns, F.lit(0).alias(own), F.lit(0).alias(other))

    salts = F.when(F.col("full_bits").bitwiseAND(bit) != 0, F.lit(_SALTS)).otherwise(F.lit(1))
    salted = marked.filter(may).withColumn("salt", F.pmod(F.xxhash64("mmsi", "timestamp"), salts).cast("int"))
    # Cells of one bit have the same salts, as their reports do.
    sizes = [f"{part}s" for part in _PART]
    parts = crowded.select(*sizes, *CELL, word.alias("word")).join(F.broadcast(bitmap), "word")
    parts = parts.select(*sizes, F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), *CELL)
    met = salted.join(parts.hint("merge"), [*CELL, "salt"], "left")
    return plain.unionByName(_parted(met, own, other).select(*columns))


def _distance(one: str, two: str) -> Column:
    return haversine_nm(
        F.col(f"{one}.latitude"), F.col(f"{one}.longitude"), F.col(f"{two}.latitude"), F.col(f"{two}.longitude")
    )


def _meetings(points: DataFrame, rules: ProximityRules, crowded: DataFrame | None, visits: int | None) -> DataFrame:
    """The join: an ``early`` and a ``late`` report of two vessels within both limits, each pair once.

    Spark's estimate does not see how often reports are replicated. So the kind of join follows from the counted ``visits``:
    many, or unknown, are merged whatever Spark's threshold; few are left to Spark.
    """
    stored = crowded is not None
    crowded = crowded if stored else crowded_cells(points, rules)
    points = points.withColumn("seconds", epoch_seconds(F.col("timestamp")))
    early = _divide(home_cells(points, rules), crowded, stored, rules.split_rows, *_PART).alias("early")
    late = _divide(reached_cells(points, rules), crowded, stored, rules.split_rows, *reversed(_PART)).alias("late")

    if visits is None or visits > rules.broadcast_visits:
        late = late.hint("merge")

    early_seconds, late_seconds = F.col("early.seconds"), F.col("late.seconds")
    earlier = (early_seconds < late_seconds) | (
        (early_seconds == late_seconds) & (F.col("early.mmsi") < F.col("late.mmsi"))
    )
    climb = F.abs(F.col("early.latitude") - F.col("late.latitude"))
    return (
        early.join(late, [*CELL, *_PART])
        .filter(earlier & (late_seconds - early_seconds <= rules.gap_seconds))
        .filter(climb <= F.lit(latitude_reach(rules.distance_nm)))
        .filter(F.col("early.mmsi") != F.col("late.mmsi"))
        .filter(_distance("early", "late") <= F.lit(rules.distance_nm))
    )


def _of_first(name: str) -> Column:
    in_order = F.col("early.mmsi") < F.col("late.mmsi")
    return F.when(in_order, F.col(f"early.{name}")).otherwise(F.col(f"late.{name}"))


def _of_second(name: str) -> Column:
    in_order = F.col("early.mmsi") < F.col("late.mmsi")
    return F.when(in_order, F.col(f"late.{name}")).otherwise(F.col(f"early.{name}"))


def _fixes(points: DataFrame, *more: str) -> DataFrame:
    columns = ["mmsi", "timestamp", "latitude", "longitude", *more]
    return expect(points, POSITION_SCHEMA, columns).select(*columns)


def proximity_pairs(
    points: DataFrame,
    rules: ProximityRules = ProximityRules(),
    crowded: DataFrame | None = None,
    visits: int | None = None,
) -> DataFrame:
    """Every pair of reports of two vessels within both limits, once; ``mmsi_1 < mmsi_2``.

    ``points`` holds one row per vessel and time (see ``unique_positions``). ``crowded`` is the
    stored result of ``crowded_cells``, ``visits`` what that counted; left out, the first becomes part of the plan (for small tables only, see ``_divide``). For the closest
    approaches alone, ``nearest_slots`` and ``pinpoint`` do without the list of all pairs.
    """
    return _meetings(_fixes(points, "name"), rules, crowded, visits).select(
        _of_first("mmsi").alias("mmsi_1"),
        _of_second("mmsi").alias("mmsi_2"),
        _of_first("name").alias("name_1"),
        _of_second("name").alias("name_2"),
        _of_first("timestamp").alias("timestamp_1"),
        _of_second("timestamp").alias("timestamp_2"),
        ((F.col("early.latitude") + F.col("late.latitude")) / 2).alias("latitude"),
        ((F.col("early.longitude") + F.col("late.longitude")) / 2).alias("longitude"),
        _distance("early", "late").alias("distance_nm"),
    )


def _slot(timestamp: Column) -> Column:
    return F.floor(epoch_seconds(timestamp) / _SLOT_SECONDS)


def meeting_slots(
    points: DataFrame,
    rules: ProximityRules = ProximityRules(),
    crowded: DataFrame | None = None,
    visits: int | None = None,
) -> DataFrame:
    """Per vessel pair and time slot of vessel 1 in which they met: the least distance.

    Two ships moored side by side meet with every report. Their meetings go from the join straight
    into a hash aggregation of one number per pair and slot; they are never sorted or shuffled.
    """
    slotted = _fixes(points).withColumn("slot", _slot(F.col("timestamp")))
    met = _meetings(slotted, rules, crowded, visits).select(
        F.least("early.mmsi", "late.mmsi").alias("mmsi_1"),
        F.greatest("early.mmsi", "late.mmsi").alias("mmsi_2"),
        _of_first("slot").alias("slot"),
        _distance("early", "late").alias("distance_nm"),
    )
    return met.groupBy("mmsi_1", "mmsi_2", "slot").agg(F.min("distance_nm").alias("distance_nm"))


def slot_day(slot: Column) -> Column:
    """The day a time slot lies in."""
    return F.to_date(from_epoch(slot * _SLOT_SECONDS))


def nearest_of(slots: DataFrame, rules: ProximityRules = ProximityRules()) -> DataFrame:
    """Of ``meeting_slots``: per vessel pair, or per encounter of one, the least distance and the first slot with it."""
    kept = ["mmsi_1", "mmsi_2"]
    if rules.per == "encounter":
        in_time = Window.partitionBy("mmsi_1", "mmsi_2").orderBy("slot")
        pause = (F.col("slot") - F.lag("slot").over(in_time)) * _SLOT_SECONDS
        fresh = F.coalesce(pause > rules.encounter_gap_seconds, F.lit(True)).cast("int")
        slots = slots.withColumn("fresh", fresh).withColumn(_ENCOUNTER, F.sum("fresh").over(in_time)).drop("fresh")
        kept.append(_ENCOUNTER)
    nearest = slots.groupBy(*kept).agg(F.min(F.struct("distance_nm", "slot")).alias("nearest"))
    return nearest.select(*kept, "nearest.slot", "nearest.distance_nm")


def nearest_slots(
    points: DataFrame,
    rules: ProximityRules = ProximityRules(),
    crowded: DataFrame | None = None,
    visits: int | None = None,
) -> DataFrame:
    """Per vessel pair, or per encounter of one: the least distance, and the first time slot of vessel 1 with that distance."""
    return nearest_of(meeting_slots(points, rules, crowded, visits), rules)


def _pair_key(table: DataFrame) -> list[str]:
    """What a row of the result is for: the vessel pair, and its encounter if there may be several."""
    return ["mmsi_1", "mmsi_2", *([_ENCOUNTER] if _ENCOUNTER in table.columns else [])]


def pinpoint(nearest: DataFrame, points: DataFrame, rules: ProximityRules = ProximityRules()) -> DataFrame:
    """The report pairs (as in ``proximity_pairs``) behind ``nearest_slots``: those at the least distance.

    The reports of both vessels around the slot are looked up by (vessel, slot). Against a stored
    ``nearest`` small enough to broadcast, ``points`` is scanned once and not shuffled. With at most
    one report per vessel and second, a pair gathers a slot's worth of reports of one vessel and
    that plus twice the time limit of the other.
    """
    first, last = F.col("slot") * _SLOT_SECONDS, (F.col("slot") + 1) * _SLOT_SECONDS - 1
    around = F.sequence(
        F.floor((first - rules.gap_seconds) / _SLOT_SECONDS), F.floor((last + rules.gap_seconds) / _SLOT_SECONDS)
    )
    sides = F.array(
        F.struct(F.lit(1).alias("side"), F.col("mmsi_1").alias("mmsi"), F.array("slot").alias("slots")),
        F.struct(F.lit(2).alias("side"), F.col("mmsi_2").alias("mmsi"), around.alias("slots")),
    )
    key = _pair_key(nearest)
    visits = nearest.select(*key, "distance_nm", F.inline(sides)).withColumn("slot", F.explode("slots"))
    heard = visits.join(_fixes(points, "name").withColumn("slot", _slot(F.col("timestamp"))), ["mmsi", "slot"])
    fix = F.struct("timestamp", "latitude", "longitude", "name")
    gathered = heard.groupBy(*key, "distance_nm").agg(
        *(F.collect_list(F.when(F.col("side") == side, fix)).alias(f"fixes_{side}") for side in (1, 2))
    )
    both = gathered.withColumn("one", F.explode("fixes_1")).withColumn("two", F.explode("fixes_2"))
    apart = epoch_seconds(F.col("one.timestamp")) - epoch_seconds(F.col("two.timestamp"))
    # Room for the last bit, in which two machines' sines may differ.
    least = F.col("distance_nm") * F.lit(1 + 1e-12) + F.lit(1e-15)
    return both.filter((F.abs(apart) <= rules.gap_seconds) & (_distance("one", "two") <= least)).select(
        *key,
        F.col("one.name").alias("name_1"),
        F.col("two.name").alias("name_2"),
        F.col("one.timestamp").alias("timestamp_1"),
        F.col("two.timestamp").alias("timestamp_2"),
        ((F.col("one.latitude") + F.col("two.latitude")) / 2).alias("latitude"),
        ((F.col("one.longitude") + F.col("two.longitude")) / 2).alias("longitude"),
        _distance("one", "two").alias("distance_nm"),
    )


def closest_approach(pairs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One candidate per vessel pair (or encounter): its closest two reports, ties broken by the earlier times.

    An aggregation, not a ranking: each map task sends on one row per vessel pair. ``keep``: columns of the pair's key to
    carry along.
    """
    best = pairs.groupBy(*_pair_key(pairs)).agg(
        F.min(
            F.struct("distance_nm", "timestamp_1", "timestamp_2", "name_1", "name_2", "latitude", "longitude")
        ).alias("best")
    )
    middle = F.expr("(unix_timestamp(best.timestamp_1) + unix_timestamp(best.timestamp_2)) div 2")
    timed = best.withColumn("collision_time", from_epoch(middle))
    identity = F.concat_ws("|", "mmsi_1", "mmsi_2", F.col("collision_time").cast("string"))
    return timed.select(
        F.sha2(identity, 256).alias("candidate_id"),
        "mmsi_1",
        "mmsi_2",
        F.col("best.name_1").alias("name_1"),
        F.col("best.name_2").alias("name_2"),
        "collision_time",
        F.col("best.latitude").alias("collision_latitude"),
        F.col("best.longitude").alias("collision_longitude"),
        F.col("best.distance_nm").alias("minimum_distance_nm"),
        *(name for name in keep if name not in CANDIDATE_COLUMNS),
    ).select(*CANDIDATE_COLUMNS, *(name for name in keep if name not in CANDIDATE_COLUMNS))


def find_candidates(
    points: DataFrame, rules: ProximityRules = ProximityRules(), crowded: DataFrame | None = None
) -> DataFrame:
    """Encounter candidates among ``points``: ``closest_approach(proximity_pairs(points))``, by the short way.

    One lazy plan. A run that can store tables keeps ``crowded_cells`` and ``nearest_slots`` between
    the steps instead (see ``plans.pipeline``).
    """
    return closest_approach(pinpoint(nearest_slots(points, rules, crowded), points, rules))
