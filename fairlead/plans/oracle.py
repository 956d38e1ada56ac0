"""DuckDB statements that answer the registered queries on the same tables.

Written from the definitions (plain windows, plain joins, no segments or staged tables), so that they check the Spark plans rather
than repeat them. One exception: ``grid_cells`` repeats the formula of the cells; whether cells find all pairs is checked by ``proximity_pairs``.
"""

from __future__ import annotations

from fairlead.functions.geo import bounding_box, latitude_reach
from fairlead.functions.identity import ALLOCATED_MIDS, BLOCKED_MMSI
from fairlead.params import Circle, CollisionRules, ProximityRules
from fairlead.plans.catalog import SAMPLE_COLLISIONS, SMALL_CIRCLE
from fairlead.schema import POSITION_COLUMNS, VALIDATED_SCHEMA
from fairlead.sources.sample import REPORTS_PER_SAILING

_DETAILS = [c for c in POSITION_COLUMNS if c not in ("mmsi", "timestamp", "latitude", "longitude")]
_NUMBERS = {"latitude", "longitude", "sog", "cog", "heading", "width", "length", "draught"}
_STAMP = "'%Y-%m-%d %H:%M:%S'"


def _listed(values) -> str:
    return ", ".join(f"'{value}'" for value in values)


def _distance(a: str, b: str, c: str, d: str) -> str:
    return (
        f"(2 * 3440 * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(({c}) - ({a})) / 2), 2) + "
        f"cos(radians({a})) * cos(radians({c})) * pow(sin(radians(({d}) - ({b})) / 2), 2)))))"
    )


def _inside(circle: Circle) -> str:
    distance = _distance("latitude", "longitude", f"{circle.latitude}::DOUBLE", f"{circle.longitude}::DOUBLE")
    return f"{distance} <= {circle.radius_nm}"


def _text_time(column: str, alias: str | None = None) -> str:
    return f"strftime({column}, {_STAMP}) AS {alias or column}"


def _shown(columns=POSITION_COLUMNS) -> str:
    parts = []
    for name in columns:
        if name in ("timestamp", "collision_time"):
            parts.append(_text_time(name))
        elif name in _NUMBERS:
            parts.append(f"round({name}, 6) AS {name}")
        else:
            parts.append(name)
    return ", ".join(parts)


REPORTS = f"""
sailing AS (
  SELECT event_id, event_type, value, CAST(event_id // 2 AS BIGINT) AS clock,
         CAST(event_id // {REPORTS_PER_SAILING} AS BIGINT) AS sailing,
         CAST(event_id % {REPORTS_PER_SAILING} // 2 AS BIGINT) AS s, CAST(user_id % 50 AS BIGINT) AS v,
         CAST(user_id % 50 // 2 AS BIGINT) AS pair, 300 + 60 * CAST(user_id % 50 // 2 AS BIGINT) AS meeting,
         CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END AS heading_sign
  FROM events),
shaped AS (
  SELECT *, TIMESTAMP '2021-12-12 23:45:00' + to_seconds(clock) AS moment,
         CAST(CASE WHEN event_id % 211 = 0 THEN 555555555 WHEN event_id % 223 = 0 THEN 999000000 + v
                   WHEN event_id % 227 = 0 OR v = 15 AND s > meeting OR v = 21 AND abs(s - meeting) > 40 THEN 12345
                   WHEN event_id % 229 = 0 THEN 123456789
                   WHEN event_id % 1009 = 5 THEN 265000000 + event_id % 1000000
                   WHEN event_id % 1013 IN (7, 17) THEN 266000000 + event_id // 1013 % 1000000
                   ELSE 219000000 + 50 * (sailing % 20000) + v END AS VARCHAR) AS id,
         CASE WHEN event_id % 239 = 0 THEN 95.0::DOUBLE WHEN event_id % 1013 = 7 THEN 55.6::DOUBLE
              WHEN event_id % 1013 = 17 THEN 55.6023::DOUBLE
              WHEN pair = 9 THEN 55.18::DOUBLE + 0.00001::DOUBLE * heading_sign
              ELSE 55.0::DOUBLE + 0.02::DOUBLE * pair + 0.00005::DOUBLE * (heading_sign * (s - meeting))
                   + CASE WHEN event_id % 97 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS lat,
         CASE WHEN event_id % 1013 IN (7, 17) THEN 14.2::DOUBLE ELSE 14.0::DOUBLE + 0.02::DOUBLE * pair END AS lon
  FROM sailing),
reports AS (
  SELECT event_id,
         CASE WHEN event_id % 233 = 0 THEN 'no time' WHEN event_id % 3 = 0 THEN '  ' || strftime(moment, '%d/%m/%Y %H:%M:%S') || ' '
              WHEN event_id % 3 = 1 THEN strftime(moment, '%Y-%m-%d %H:%M:%S')
              ELSE strftime(moment, '%Y-%m-%dT%H:%M:%S') END AS time_text,
         CASE WHEN event_id % 7 = 0 THEN ' ' || id || '  ' ELSE id END AS mmsi_text,
         CAST(lat AS VARCHAR) AS lat_text, CAST(lon AS VARCHAR) AS lon_text, ' ' || event_type AS status_text,
         CASE WHEN event_id % 131 = 0 THEN 'n/a' WHEN event_id % 137 = 0 THEN ''
              ELSE ' ' || CASE WHEN pair = 9 THEN '0.2' WHEN v = 25 THEN 'n/a' WHEN s <= meeting THEN '10.0' ELSE '6.0' END END AS sog_text,
         CASE WHEN heading_sign = 1 THEN '0.0' ELSE '180.0' END AS cog_text,
         CASE WHEN event_id % 11 = 0 THEN 'unknown' ELSE CAST(event_id % 360 AS VARCHAR) END AS heading_text,
         ' V' || CAST(v AS VARCHAR) || ' ' AS name_text,
         CASE WHEN v % 10 = 3 THEN 'Pilot' WHEN event_id % 5 = 0 THEN 'Undefined' ELSE 'Cargo' END || ' ' AS type_text,
         CAST(10 + v % 20 AS VARCHAR) AS width_text, CAST(100 + v AS VARCHAR) AS length_text,
         CAST(value AS VARCHAR) AS draught_text
  FROM shaped)"""

_PARSED = (
    "coalesce(try_strptime(trim({0}), '%d/%m/%Y %H:%M:%S'), try_strptime(trim({0}), '%Y-%m-%d %H:%M:%S'), "
    "try_strptime(trim({0}), '%Y-%m-%dT%H:%M:%S'))"
)

TYPED = f"""{REPORTS},
typed AS (
  SELECT trim(mmsi_text) AS mmsi, {_PARSED.format("time_text")} AS timestamp,
         try_cast(lat_text AS DOUBLE) AS latitude, try_cast(lon_text AS DOUBLE) AS longitude,
         trim(status_text) AS navigational_status, try_cast(trim(sog_text) AS DOUBLE) AS sog,
         try_cast(cog_text AS DOUBLE) AS cog, try_cast(heading_text AS DOUBLE) AS heading,
         trim(name_text) AS name, trim(type_text) AS ship_type, try_cast(width_text AS DOUBLE) AS width,
         try_cast(length_text AS DOUBLE) AS length, try_cast(draught_text AS DOUBLE) AS draught
  FROM reports)"""

CLEAN = f"""{TYPED},
clean AS (
  SELECT * FROM typed
  WHERE regexp_full_match(mmsi, '[0-9]{{9}}') AND mmsi NOT IN ({_listed(BLOCKED_MMSI)})
    AND mmsi <> repeat(substr(mmsi, 1, 1), 9) AND substr(mmsi, 1, 3) IN ({_listed(ALLOCATED_MIDS)})
    AND timestamp IS NOT NULL AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180
    AND {_inside(Circle(radius_nm=75.0))})"""

CONFLICTS = f"""{CLEAN},
conflicts AS (
  SELECT mmsi, timestamp FROM clean GROUP BY mmsi, timestamp HAVING count(DISTINCT (latitude, longitude)) > 1),
agreed AS (
  SELECT * FROM clean c
  WHERE NOT EXISTS (SELECT 1 FROM conflicts k WHERE k.mmsi = c.mmsi AND k.timestamp = c.timestamp))"""

_FIRST_COPY = (
    "row_number() OVER (PARTITION BY mmsi, timestamp, latitude, longitude ORDER BY "
    + ", ".join(f"{name} NULLS FIRST" for name in _DETAILS)
    + ") AS copy"
)

UNIQUE = f"""{CONFLICTS},
singles AS (SELECT * EXCLUDE (copy) FROM (SELECT *, {_FIRST_COPY} FROM agreed) WHERE copy = 1)"""


def _knots(hours: str, a: str, b: str, c: str, d: str) -> str:
    return f"CASE WHEN {hours} > 0 THEN {_distance(a, b, c, d)} / ({hours}) END"


_BACK = "((epoch(timestamp) - epoch(t0)) / 3600)"
_AHEAD = "((epoch(t2) - epoch(timestamp)) / 3600)"

SPEEDS = f"""{UNIQUE},
lined AS (
  SELECT *, lag(timestamp) OVER w AS t0, lag(latitude) OVER w AS y0, lag(longitude) OVER w AS x0,
         lead(timestamp) OVER w AS t2, lead(latitude) OVER w AS y2, lead(longitude) OVER w AS x2
  FROM singles WINDOW w AS (PARTITION BY mmsi ORDER BY timestamp)),
speeds AS (
  SELECT *, {_BACK} AS previous_hours, {_AHEAD} AS next_hours,
         {_knots(_BACK, "y0", "x0", "latitude", "longitude")} AS previous_speed_knots,
         {_knots(_AHEAD, "latitude", "longitude", "y2", "x2")} AS next_speed_knots
  FROM lined),
spiked AS (
  SELECT *, previous_speed_knots > 60 AND next_speed_knots > 60 AS middle_spike,
         (previous_speed_knots IS NULL AND next_speed_knots > 200)
           OR (next_speed_knots IS NULL AND previous_speed_knots > 200) AS edge_spike
  FROM speeds)"""

TRACKS = f"""{SPEEDS},
tracks AS (SELECT {", ".join(POSITION_COLUMNS)} FROM spiked WHERE NOT middle_spike AND NOT edge_spike),
points AS (SELECT *, epoch(timestamp)::BIGINT AS sec FROM tracks WHERE {_inside(Circle())})"""

# Minutes only keep the self-join from comparing everything with everything.
PAIRS = f"""{TRACKS},
pairs AS (
  SELECT a.mmsi AS mmsi_1, b.mmsi AS mmsi_2, a.name AS name_1, b.name AS name_2,
         a.timestamp AS timestamp_1, b.timestamp AS timestamp_2, a.sec AS sec_1, b.sec AS sec_2,
         (a.latitude + b.latitude) / 2 AS latitude, (a.longitude + b.longitude) / 2 AS longitude,
         {_distance("a.latitude", "a.longitude", "b.latitude", "b.longitude")} AS distance_nm
  FROM (SELECT *, unnest([sec // 60 - 1, sec // 60, sec // 60 + 1]) AS minute FROM points) a
  JOIN (SELECT *, sec // 60 AS minute FROM points) b ON a.minute = b.minute
  WHERE a.mmsi < b.mmsi AND abs(a.sec - b.sec) <= 60
    AND {_distance("a.latitude", "a.longitude", "b.latitude", "b.longitude")} <= 0.05::DOUBLE)"""

_CANDIDATE_ROWS = f"""candidates AS (
  SELECT sha256(mmsi_1 || '|' || mmsi_2 || '|' || strftime(met, {_STAMP})) AS candidate_id, mmsi_1, mmsi_2, name_1, name_2,
         met AS collision_time, latitude AS collision_latitude, longitude AS collision_longitude,
         distance_nm AS minimum_distance_nm
  FROM (SELECT *, TIMESTAMP '1970-01-01 00:00:00' + to_seconds((sec_1 + sec_2) // 2) AS met FROM ranked WHERE place = 1))"""

CANDIDATES = f"""{PAIRS},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY mmsi_1, mmsi_2 ORDER BY distance_nm, timestamp_1, timestamp_2) AS place
  FROM pairs),
{_CANDIDATE_ROWS},
sides AS (
  SELECT candidate_id, collision_time, '1' AS vessel_side, mmsi_1 AS mmsi FROM candidates
  UNION ALL
  SELECT candidate_id, collision_time, '2' AS vessel_side, mmsi_2 AS mmsi FROM candidates)"""

ENCOUNTERS = f"""{PAIRS},
slots AS (SELECT DISTINCT mmsi_1, mmsi_2, sec_1 // 10 AS slot FROM pairs),
marked AS (
  SELECT *, coalesce(10 * (slot - lag(slot) OVER w) > 60, true) AS fresh FROM slots
  WINDOW w AS (PARTITION BY mmsi_1, mmsi_2 ORDER BY slot)),
sessions AS (
  SELECT *, sum(fresh::INT) OVER (PARTITION BY mmsi_1, mmsi_2 ORDER BY slot) AS encounter FROM marked),
ranked AS (
  SELECT p.*, row_number() OVER (PARTITION BY mmsi_1, mmsi_2, encounter ORDER BY distance_nm, timestamp_1, timestamp_2) AS place
  FROM pairs p JOIN sessions s USING (mmsi_1, mmsi_2) WHERE s.slot = p.sec_1 // 10),
{_CANDIDATE_ROWS}"""

STATS = f"""{CANDIDATES},
before_rows AS (
  SELECT s.candidate_id, s.vessel_side, t.* FROM sides s JOIN tracks t ON s.mmsi = t.mmsi
   AND t.timestamp >= s.collision_time - INTERVAL 10 MINUTE AND t.timestamp <= s.collision_time),
places AS (
  SELECT candidate_id, vessel_side, count(*) AS before_point_count, quantile_disc(sog, 0.5) AS before_median_sog,
         arg_min(latitude, timestamp) AS first_latitude, arg_min(longitude, timestamp) AS first_longitude,
         arg_max(latitude, timestamp) AS last_latitude, arg_max(longitude, timestamp) AS last_longitude
  FROM before_rows GROUP BY candidate_id, vessel_side),
before_stats AS (
  SELECT *, {_distance("first_latitude", "first_longitude", "last_latitude", "last_longitude")} * 1852 AS before_moved_meters
  FROM places),
after_stats AS (
  SELECT s.candidate_id, s.vessel_side, count(t.timestamp) AS after_point_count, quantile_disc(t.sog, 0.5) AS after_median_sog
  FROM sides s LEFT JOIN tracks t ON s.mmsi = t.mmsi
   AND t.timestamp > s.collision_time AND t.timestamp <= s.collision_time + INTERVAL 10 MINUTE
  GROUP BY s.candidate_id, s.vessel_side),
types AS (
  SELECT mmsi, ship_type FROM (
    SELECT mmsi, ship_type, row_number() OVER (PARTITION BY mmsi ORDER BY timestamp DESC, ship_type DESC) AS age
    FROM tracks WHERE ship_type IS NOT NULL AND ship_type <> 'Undefined') WHERE age = 1)"""

_BEFORE = (
    "before_point_count", "before_median_sog", "before_moved_meters", "first_latitude", "first_longitude",
    "last_latitude", "last_longitude",
)
_AFTER = ("after_point_count", "after_median_sog")


def _side_columns(alias: str, side: str, names) -> str:
    return ", ".join(f"{alias}.{name} AS vessel_{side}_{name}" for name in names)


TYPED_CANDIDATES = f"""{STATS},
typed_candidates AS (
  SELECT c.*, p.ship_type AS vessel_1_ship_type, q.ship_type AS vessel_2_ship_type
  FROM candidates c LEFT JOIN types p ON p.mmsi = c.mmsi_1 LEFT JOIN types q ON q.mmsi = c.mmsi_2),
sided AS (
  SELECT b1.candidate_id, {_side_columns("b1", "1", _BEFORE)}, {_side_columns("b2", "2", _BEFORE)},
         {_side_columns("a1", "1", _AFTER)}, {_side_columns("a2", "2", _AFTER)}
  FROM (SELECT * FROM before_stats WHERE vessel_side = '1') b1
  JOIN (SELECT * FROM before_stats WHERE vessel_side = '2') b2 USING (candidate_id)
  JOIN (SELECT * FROM after_stats WHERE vessel_side = '1') a1 USING (candidate_id)
  JOIN (SELECT * FROM after_stats WHERE vessel_side = '2') a2 USING (candidate_id))"""


def _scores(rules: CollisionRules) -> str:
    def moving(side: int) -> str:
        return (
            f"(vessel_{side}_before_median_sog >= {rules.moving_knots} "
            f"OR vessel_{side}_before_moved_meters >= {rules.moving_metres})"
        )

    def still(side: int) -> str:
        return (
            f"vessel_{side}_before_median_sog < {rules.stationary_knots} "
            f"AND vessel_{side}_before_moved_meters < {rules.stationary_metres}"
        )

    def drop(side: int) -> str:
        before, after = f"vessel_{side}_before_median_sog", f"vessel_{side}_after_median_sog"
        return f"CASE WHEN {before} > 0 THEN ({before} - {after}) / {before} END"

    apart = _distance(
        "vessel_1_first_latitude", "vessel_1_first_longitude", "vessel_2_first_latitude", "vessel_2_first_longitude"
    )
    excluded = _listed(rules.excluded_types)
    return f"""{TYPED_CANDIDATES},
measured AS (
  SELECT *, {moving(1)} AS vessel_1_was_moving, {moving(2)} AS vessel_2_was_moving,
         {still(1)} AND {still(2)} AS both_were_stationary,
         vessel_1_after_median_sog AS vessel_1_after_speed, vessel_2_after_median_sog AS vessel_2_after_speed,
         {drop(1)} AS vessel_1_speed_drop_pct, {drop(2)} AS vessel_2_speed_drop_pct,
         {apart} * 1852 AS pre_event_pair_distance_meters, minimum_distance_nm * 1852 AS minimum_distance_meters,
         vessel_1_ship_type IN ({excluded}) AS vessel_1_is_excluded_type,
         vessel_2_ship_type IN ({excluded}) AS vessel_2_is_excluded_type
  FROM typed_candidates JOIN sided USING (candidate_id)),
scored AS (
  SELECT *, coalesce(vessel_1_speed_drop_pct, 0) + coalesce(vessel_2_speed_drop_pct, 0) AS combined_speed_drop_pct,
         pre_event_pair_distance_meters - minimum_distance_meters AS approach_distance_meters,
         pre_event_pair_distance_meters - minimum_distance_meters > 0 AS vessels_approached
  FROM measured),
validated AS (
  SELECT * FROM scored
  WHERE vessel_1_was_moving AND vessel_2_was_moving AND NOT both_were_stationary
    AND least(vessel_1_before_point_count, vessel_2_before_point_count) >= {max(rules.min_points, rules.collision_min_points)}
    AND vessel_1_before_median_sog >= {rules.moving_knots} AND vessel_2_before_median_sog >= {rules.moving_knots}
    AND vessel_1_before_moved_meters >= {max(rules.moving_metres, rules.collision_moved_metres)}
    AND vessel_2_before_moved_meters >= {max(rules.moving_metres, rules.collision_moved_metres)}
    AND minimum_distance_meters <= {rules.collision_metres} AND combined_speed_drop_pct >= {rules.min_speed_drop}
    AND approach_distance_meters >= {rules.collision_approach_metres}
    AND NOT coalesce(vessel_1_is_excluded_type, false) AND NOT coalesce(vessel_2_is_excluded_type, false))"""


def _wide() -> str:
    parts = []
    for field in VALIDATED_SCHEMA:
        kind, name = field.dataType.typeName(), field.name
        if kind == "double":
            parts.append(f"round({name}, 6) AS {name}")
        else:
            parts.append(_text_time(name) if kind == "timestamp_ntz" else name)
    return ", ".join(parts)


def _rounded(names) -> str:
    return ", ".join(f"round({name}, 6) AS {name}" if "count" not in name else name for name in names)


_CANDIDATE = (
    "candidate_id, mmsi_1, mmsi_2, name_1, name_2, "
    + _text_time("collision_time")
    + ", round(collision_latitude, 6) AS collision_latitude, round(collision_longitude, 6) AS collision_longitude"
    + ", round(minimum_distance_nm, 6) AS minimum_distance_nm"
)
_INSTANT = f"mmsi, {_text_time('timestamp')}"


def _grid(rules: ProximityRules = ProximityRules()) -> str:
    reach = latitude_reach(rules.distance_nm)
    height, bucket = 4 * reach, 2 * rules.gap_seconds

    def cells(row: str) -> str:
        return (
            f"greatest(1, CAST(floor({360.0 / height!r}::DOUBLE * cos(radians(least(90.0::DOUBLE, "
            f"greatest(abs({row} * {height!r}::DOUBLE), abs(({row} + 1) * {height!r}::DOUBLE)))))) AS BIGINT))"
        )

    def column(longitude: str) -> str:
        return f"CAST(floor(({longitude} + 180) * n / 360.0::DOUBLE) AS BIGINT)"

    sideways = f"(degrees(asin(sin({rules.distance_nm}::DOUBLE / 3440) / cos(radians(latitude)))) + 1e-9::DOUBLE)"
    return f"""{CLEAN},
inner_points AS (SELECT *, epoch(timestamp)::BIGINT AS sec FROM clean WHERE {_inside(Circle())}),
lying AS (
  SELECT sec // {bucket} AS time_bucket, lat_cell, {column("longitude")} % n AS lon_cell
  FROM (SELECT *, {cells("lat_cell")} AS n
        FROM (SELECT *, CAST(floor(latitude / {height!r}::DOUBLE) AS BIGINT) AS lat_cell FROM inner_points))),
slots AS (
  SELECT *, unnest(generate_series((sec - {rules.gap_seconds}) // {bucket}, sec // {bucket})) AS time_bucket
  FROM inner_points),
banded AS (
  SELECT *, unnest(generate_series(CAST(floor((latitude - {reach!r}::DOUBLE) / {height!r}::DOUBLE) AS BIGINT),
                                   CAST(floor((latitude + {reach!r}::DOUBLE) / {height!r}::DOUBLE) AS BIGINT))) AS lat_cell
  FROM slots),
looking AS (
  SELECT time_bucket, lat_cell, lon_cell % n AS lon_cell
  FROM (SELECT *, unnest(generate_series({column(f"(longitude - {sideways})")}, {column(f"(longitude + {sideways})")})) AS lon_cell
        FROM (SELECT *, {cells("lat_cell")} AS n FROM banded)))"""


def _with(steps: str, query: str) -> str:
    return f"WITH {steps.strip()}\n{query}"


def statements() -> dict[str, str]:
    rules = SAMPLE_COLLISIONS
    south, north, west, east = bounding_box(SMALL_CIRCLE.latitude, SMALL_CIRCLE.longitude, SMALL_CIRCLE.radius_nm)
    written = (
        "CASE event_id % 50 WHEN 3 THEN 'not a time' WHEN 7 THEN '1/12/2021 00:00:00' WHEN 11 THEN '' "
        "WHEN 13 THEN '31/02/2021 00:00:00' ELSE time_text END"
    )
    # DuckDB also reads one-digit days; the format asks for two.
    parsed = f"CASE WHEN NOT regexp_matches(written, '^ *[0-9]/') THEN {_PARSED.format('written')} END"
    per_day = _with(
        CLEAN, "SELECT strftime(timestamp, '%Y-%m-%d') AS event_date, count(*) AS reports FROM clean GROUP BY 1"
    )
    shown = _shown()
    candidates = f"SELECT {_CANDIDATE} FROM candidates"
    near = """JOIN tracks t ON s.mmsi = t.mmsi AND t.timestamp >= s.collision_time - INTERVAL 10 MINUTE
      AND t.timestamp <= s.collision_time + INTERVAL 10 MINUTE"""
    paths = f"""
      SELECT s.candidate_id, s.vessel_side, s.mmsi,
             any_value(CASE s.vessel_side WHEN '1' THEN c.name_1 ELSE c.name_2 END) || ' (' || s.mmsi || ')' AS label,
             count(*) AS n_points, min(t.timestamp) AS start_ts, arg_min(t.latitude, t.timestamp) AS start_latitude,
             arg_min(t.longitude, t.timestamp) AS start_longitude, max(t.timestamp) AS end_ts,
             arg_max(t.latitude, t.timestamp) AS end_latitude, arg_max(t.longitude, t.timestamp) AS end_longitude
      FROM sides s JOIN candidates c USING (candidate_id) {near} GROUP BY s.candidate_id, s.vessel_side, s.mmsi"""
    head = """'{"collision_found":true,"collision_count":' || count(*) || ',"collisions":['"""
    frame = f"""
      SELECT CASE count(*) WHEN 0 THEN '{{"collision_found":false}}' WHEN 1 THEN NULL ELSE {head} END AS frame FROM validated
      UNION ALL SELECT CASE WHEN count(*) > 1 THEN ']}}' END FROM validated"""
    entry_columns = f"candidate_id, mmsi_1, mmsi_2, name_1, name_2, {_text_time('collision_time')}"
    no_entry = ", ".join(
        f"CAST(NULL AS VARCHAR) AS {n}" for n in ("candidate_id", "mmsi_1", "mmsi_2", "name_1", "name_2", "collision_time")
    )
    features = f"""SELECT candidate_id, vessel_side, label, {_text_time("start_ts", "start_time")}, {_text_time("end_ts", "end_time")},
                CASE WHEN n_points > 1 THEN 'LineString' ELSE 'Point' END AS geometry,
                CASE WHEN n_points > 1 THEN n_points ELSE 0 END AS points"""
    document = _with(
        _scores(rules),
        f"""SELECT frame, {no_entry} FROM ({frame}) WHERE frame IS NOT NULL
            UNION ALL SELECT CAST(NULL AS VARCHAR) AS frame, {entry_columns} FROM validated""",
    )
    found_paths = paths.replace("FROM sides s", "FROM (SELECT * FROM sides WHERE candidate_id IN (SELECT candidate_id FROM validated)) s")
    before_columns = f"candidate_id, vessel_side, {_rounded(_BEFORE)}"
    pairs = _with(
        PAIRS,
        f"""SELECT mmsi_1, mmsi_2, name_1, name_2, {_text_time("timestamp_1")}, {_text_time("timestamp_2")},
            round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, round(distance_nm, 6) AS distance_nm
            FROM pairs""",
    )
    return {
        "parse_timestamps": _with(
            REPORTS,
            f"SELECT event_id, written, strftime({parsed}, {_STAMP}) AS parsed FROM (SELECT event_id, {written} AS written FROM reports)",
        ),
        "cast_numerics": _with(TYPED, f"SELECT {_shown([c for c in POSITION_COLUMNS if c != 'timestamp'])} FROM typed"),
        "mmsi_validity": _with(
            TYPED,
            f"""SELECT CASE WHEN mmsi IS NULL OR NOT regexp_full_match(mmsi, '[0-9]{{9}}') THEN 'format'
                            WHEN mmsi IN ({_listed(BLOCKED_MMSI)}) THEN 'blocked'
                            WHEN mmsi = repeat(substr(mmsi, 1, 1), 9) THEN 'repeated'
                            WHEN substr(mmsi, 1, 3) NOT IN ({_listed(ALLOCATED_MIDS)}) THEN 'unallocated'
                            ELSE 'usable' END AS reason, count(*) AS reports FROM typed GROUP BY 1""",
        ),
        "clean_positions": _with(CLEAN, f"SELECT {shown} FROM clean"),
        "daily_ingest_counts": per_day,
        "csv_ingest_counts": per_day,
        "stream_ingest_counts": per_day,
        "mixed_ingest_counts": per_day,
        "haversine_distance": _with(
            TYPED,
            f"""SELECT {_INSTANT}, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude,
                round({_distance("latitude", "longitude", "55.225::DOUBLE", "14.245::DOUBLE")}, 6) AS distance_nm FROM typed""",
        ),
        "bounding_box_filter": _with(
            CLEAN,
            f"""SELECT {_INSTANT}, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM clean
                WHERE latitude BETWEEN {south!r}::DOUBLE AND {north!r}::DOUBLE
                  AND longitude BETWEEN {west!r}::DOUBLE AND {east!r}::DOUBLE""",
        ),
        "area_filter": _with(CLEAN, f"SELECT {shown} FROM clean WHERE {_inside(SMALL_CIRCLE)}"),
        "conflicting_positions": _with(CONFLICTS, f"SELECT {_INSTANT} FROM conflicts"),
        "drop_conflicts": _with(CONFLICTS, f"SELECT {shown} FROM agreed"),
        "dedupe_positions": _with(
            CLEAN, f"SELECT {shown} FROM (SELECT *, {_FIRST_COPY} FROM clean) WHERE copy = 1"
        ),
        "unique_positions": _with(UNIQUE, f"SELECT {shown} FROM singles"),
        "neighbour_speeds": _with(
            SPEEDS,
            f"""SELECT {_INSTANT}, round(previous_hours, 6) AS previous_hours, round(next_hours, 6) AS next_hours,
                round(previous_speed_knots, 6) AS previous_speed_knots, round(next_speed_knots, 6) AS next_speed_knots
                FROM speeds""",
        ),
        "gps_jump_clean": _with(TRACKS, f"SELECT {shown} FROM tracks"),
        "gps_jump_clean_limit": _with(
            SPEEDS,
            f"""SELECT {shown} FROM spiked
                WHERE NOT coalesce(middle_spike, false) AND NOT coalesce(edge_spike, false)""",
        ),
        "grid_cells": _with(
            _grid(),
            """SELECT time_bucket, lat_cell, lon_cell, CAST(sum(home) AS BIGINT) AS reports, CAST(sum(1 - home) AS BIGINT) AS visits
               FROM (SELECT *, 1 AS home FROM lying UNION ALL SELECT *, 0 AS home FROM looking)
               GROUP BY time_bucket, lat_cell, lon_cell""",
        ),
        "proximity_pairs": pairs,
        "proximity_pairs_split": pairs,
        "closest_approach": _with(CANDIDATES, candidates),
        "encounter_candidates": _with(ENCOUNTERS, candidates),
        "candidate_sides": _with(
            CANDIDATES, f"SELECT candidate_id, {_text_time('collision_time')}, vessel_side, mmsi FROM sides"
        ),
        "before_stats": _with(STATS, f"SELECT {before_columns} FROM before_stats"),
        "after_stats": _with(STATS, f"SELECT candidate_id, vessel_side, {_rounded(_AFTER)} FROM after_stats"),
        "side_selection": _with(
            STATS,
            "SELECT candidate_id, "
            + ", ".join(
                f"round({n}, 6) AS vessel_2_{n}" if "count" not in n else f"{n} AS vessel_2_{n}" for n in _BEFORE
            )
            + " FROM before_stats WHERE vessel_side = '2'",
        ),
        "side_pivot": _with(
            TYPED_CANDIDATES,
            "SELECT candidate_id, "
            + _rounded([f"vessel_{side}_{n}" for side in "12" for n in (*_BEFORE, *_AFTER)])
            + " FROM sided",
        ),
        "vessel_types": _with(STATS, "SELECT mmsi, ship_type FROM types"),
        "typed_candidates": _with(
            TYPED_CANDIDATES, f"SELECT {_CANDIDATE}, vessel_1_ship_type, vessel_2_ship_type FROM typed_candidates"
        ),
        "scored_candidates": _with(_scores(rules), f"SELECT {_wide()} FROM scored"),
        "validated_collisions": _with(_scores(rules), f"SELECT {_wide()} FROM validated"),
        "collision_result": _with(
            _scores(rules),
            f"""SELECT {_wide()}, true AS collision_found, (SELECT count(*) FROM validated) AS collision_count
                FROM validated ORDER BY collision_time, candidate_id""",
        ),
        "collision_document": document,
        "trajectory_points": _with(
            CANDIDATES,
            f"""SELECT s.candidate_id, s.vessel_side, s.mmsi, {_text_time("t.timestamp", "timestamp")},
                round(t.latitude, 6) AS latitude, round(t.longitude, 6) AS longitude, t.name FROM sides s {near}""",
        ),
        "trajectory_paths": _with(
            CANDIDATES,
            f"""SELECT candidate_id, vessel_side, mmsi, label, n_points, {_text_time("start_ts")},
                round(start_latitude, 6) AS start_latitude, round(start_longitude, 6) AS start_longitude,
                {_text_time("end_ts")}, round(end_latitude, 6) AS end_latitude, round(end_longitude, 6) AS end_longitude
                FROM ({paths})""",
        ),
        "trajectory_features": _with(CANDIDATES, f"{features} FROM ({paths})"),
        "pipeline_document": document,
        "pipeline_trajectories": _with(_scores(rules), f"{features} FROM ({found_paths})"),
        "incremental_candidates": _with(CANDIDATES, candidates),
    }
