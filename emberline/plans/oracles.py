"""The registered queries as plain SQL, for checking. Written on their own: joins are brute force here (every cell against
every station), so that agreement says something about the bin joins."""

from __future__ import annotations

import re

from emberline import config as C
from emberline.plans.adapters import VIEWS, sql_of
from emberline.plans.queries import CONFIDENCE_MIN, GRID_KM

# Fixed values, written out so that a wrong constant of the package does not pass on both sides.
BOX = C.Bounds(41.75, 60.0, -137.72, -52.67)
ELEMENT_LIST = "'TMAX', 'TMIN', 'TAVG', 'PRCP', 'SNWD'"
# (lat_min, lat_max, lon_min, lon_max); None is open.
WATER_BOXES = ((41.75, 49.0, -92.0, -76.0), (None, None, -65.0, None), (48.0, None, None, -125.0), (58.0, None, None, None))
URBAN_BOXES = (
    (43.0, 44.5, -80.0, -78.5), (49.0, 49.5, -123.5, -122.5), (45.3, 45.7, -74.0, -73.5), (51.0, 51.2, -114.2, -113.8),
    (53.4, 53.7, -113.7, -113.3), (50.0, 50.5, -97.0, -96.5), (46.8, 47.0, -71.2, -71.0), (44.6, 44.8, -63.8, -63.4),
)
TERRAIN_CODE = {"forest": 1, "land": 2, "urban": 3, "water": 4}
TARGET_QUOTA = {"forest": 200, "land": 125, "urban": 100, "water": 75}
LEAST_CONFIDENCE = {"forest": 0.4, "land": 0.3, "urban": 0.7, "water": 0.1}
DATES_PER_CELL = {"train": 10, "test": 20}
WATER_DATES = {"train": ("2022-06-01", "2023-08-31"), "test": ("2024-06-01", "2024-08-31")}
MEASURES = ("tmax", "tmin", "tavg", "prcp", "snwd")
MIXED = ("tmax", "tmin", "tavg", "temp_range", "prcp", "snwd", "data_completeness")


def inside(lat: str, lon: str) -> str:
    return f"({lat} BETWEEN {BOX.lat_min} AND {BOX.lat_max} AND {lon} BETWEEN {BOX.lon_min} AND {BOX.lon_max})"


def haversine(lat1, lon1, lat2, lon2) -> str:
    return (
        f"2 * 6371.0e0 * asin(least(1.0e0, sqrt(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1}))"
        f" * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))))"
    )


def euclid(lat1, lon1, lat2, lon2) -> str:
    return f"sqrt(({lat1} - {lat2}) * ({lat1} - {lat2}) + ({lon1} - {lon2}) * ({lon1} - {lon2}))"


def season(m: str) -> str:
    return (
        f"CASE WHEN {m} IN (12, 1, 2) THEN 'winter' WHEN {m} IN (3, 4, 5) THEN 'spring'"
        f" WHEN {m} IN (6, 7, 8) THEN 'summer' ELSE 'fall' END"
    )


def wave(m: str, shift: int) -> str:
    return f"sin(2 * pi() * ({m} - {shift}) / 12.0e0)"


def default_of(measure: str, m: str) -> str:
    avg, spread = f"(10.0e0 + 15.0e0 * {wave(m, 3)})", f"(8.0e0 + 4.0e0 * {wave(m, 6)})"
    return {
        "tmax": f"{avg} + {spread} / 2",
        "tmin": f"{avg} - {spread} / 2",
        "tavg": avg,
        "temp_range": spread,
        "prcp": f"greatest(0.0e0, 2.0e0 + {wave(m, 6)})",
        "snwd": f"CASE WHEN {m} IN (11, 12, 1, 2, 3) THEN greatest(0.0e0, 10.0e0 * {wave(m, 12)}) ELSE 0.0e0 END",
        "data_completeness": "0.0e0",
    }[measure]


def box_test(lat, lon, box) -> str:
    tests = zip((f"{lat} >=", f"{lat} <=", f"{lon} >=", f"{lon} <="), box)
    return "(" + " AND ".join(f"{t} {v}" for t, v in tests if v is not None) + ")"


WATER = "(" + " OR ".join(box_test("center_lat", "center_lon", b) for b in WATER_BOXES) + ")"
URBAN = "(" + " OR ".join(box_test("center_lat", "center_lon", b) for b in URBAN_BOXES) + ")"


def terrain_columns() -> str:
    return (
        f"CASE WHEN {URBAN} THEN 'urban' WHEN {WATER} THEN 'water' WHEN center_lat >= 45.0 THEN 'forest' ELSE 'land' END"
        f" AS terrain_type, CAST({WATER} AS INT) AS is_water, CAST({URBAN} AS INT) AS urban_flag"
    )


def grid_sql(regions: str, km: float) -> str:
    """Cells of all regions; ids by a plain row number over the ordered cells."""
    step = f"({km}e0 / 111.32e0)"
    return f"""SELECT region_id, row_number() OVER (PARTITION BY region_id ORDER BY i, j) AS cell_id, center_lat, center_lon
 FROM (SELECT region_id, i, center_lat, unnest(range(CAST(ceil((lon_max - lon_min) / lon_step) AS BIGINT))) AS j,
 lon_min + j * lon_step AS center_lon FROM (SELECT *, lat_min + i * {step} AS center_lat,
 {km}e0 / (111.32e0 * cos(radians(lat_min + i * {step}))) AS lon_step FROM (SELECT *,
 unnest(range(CAST(ceil((lat_max - lat_min) / {step}) AS BIGINT))) AS i FROM ({regions}))))"""


def full_grid(km: float) -> str:
    region = (
        f"SELECT 'grid' AS region_id, {BOX.lat_min}e0 AS lat_min, {BOX.lat_max}e0 AS lat_max, {BOX.lon_min}e0 AS lon_min,"
        f" {BOX.lon_max}e0 AS lon_max"
    )
    return f"SELECT cell_id, center_lat, center_lon, {terrain_columns()} FROM ({grid_sql(region, km)})"


def assigned(cells: str) -> str:
    """1, 3 or 5 stations per cell, from all cell-station pairs."""
    near = euclid("c.center_lat", "c.center_lon", "s.latitude", "s.longitude")
    km = haversine("c.center_lat", "c.center_lon", "s.latitude", "s.longitude")
    return f"""SELECT cell_id, station_id, dist_km, rnk, primary_station, primary_distance FROM (
 SELECT *, row_number() OVER w AS rnk, first_value(station_id) OVER w AS primary_station,
 first_value(dist_km) OVER w AS primary_distance FROM (
 SELECT c.cell_id, s.station_id, {km} AS dist_km,
 row_number() OVER (PARTITION BY c.cell_id ORDER BY round({near}, 9), s.station_id) AS n
 FROM {cells} c CROSS JOIN v_stations s) WHERE n <= 10
 WINDOW w AS (PARTITION BY cell_id ORDER BY round(dist_km, 6), station_id))
 WHERE rnk <= CASE WHEN primary_distance < 50 THEN 1 WHEN primary_distance < 200 THEN 3 ELSE 5 END"""


def interpolated(assignment: str, mode: str = "idw") -> str:
    one = f"{assignment} WHERE rnk = 1"
    used = one if mode == "nearest" else assignment
    mixed = ", ".join(
        f"CASE WHEN count(w.{m}) = count(*) THEN CASE WHEN count(*) = 1 THEN max(w.{m}) ELSE"
        f" sum(w.{m} / (a.dist_km * a.dist_km)) / sum(1 / (a.dist_km * a.dist_km)) END END AS {m}"
        for m in MIXED
    )
    m = "month(s.date)"
    values = ", ".join(
        f"CASE WHEN n >= 1 THEN r.{x} ELSE {default_of(x, m)} END AS {x}" for x in ("tmax", "tmin", "tavg", "temp_range", "prcp", "snwd")
    )
    return f"""SELECT s.cell_id, s.date, {values}, CAST(year(s.date) AS INT) AS year, CAST({m} AS INT) AS month,
 CAST(dayofyear(s.date) AS INT) AS day_of_year, {season(m)} AS season,
 CASE WHEN n >= 1 THEN r.data_completeness ELSE 0.0e0 END AS data_completeness,
 CASE WHEN n IS NULL THEN 'seasonal_default' WHEN n = 1 THEN 'nearest_station' ELSE 'distance_weighted' END AS interpolation_method,
 CASE WHEN n >= 1 THEN primary_station END AS nearest_station_id,
 CASE WHEN n >= 1 THEN primary_distance END AS nearest_station_distance_km,
 CAST(coalesce(n, 0) AS INT) AS station_count_used,
 CASE WHEN n IS NULL THEN 0.1e0 WHEN n = 1 THEN greatest(0.1e0, 1 - primary_distance / 100.0e0)
 ELSE greatest(0.1e0, 1 - primary_distance / 200.0e0) END AS confidence_score
 FROM (SELECT a.cell_id, a.primary_station, a.primary_distance, d.date FROM (SELECT * FROM {one}) a
 CROSS JOIN (SELECT DISTINCT date FROM v_weather) d) s
 LEFT JOIN (SELECT a.cell_id, w.date, count(*) AS n, {mixed} FROM (SELECT * FROM {used}) a
 JOIN v_weather w ON a.station_id = w.station_id GROUP BY a.cell_id, w.date) r
 ON s.cell_id = r.cell_id AND s.date = r.date"""


def polygon_edges() -> str:
    return r"""SELECT shape_id, x1, y1, x2, y2 FROM (
 SELECT shape_id, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM (
 SELECT shape_id, ring_no, pos, CAST(string_split(trim(pt), ' ')[1] AS DOUBLE) AS x, CAST(string_split(trim(pt), ' ')[2] AS DOUBLE) AS y
 FROM (SELECT shape_id, ring_no, unnest(string_split(ring, ',')) AS pt, generate_subscripts(string_split(ring, ','), 1) AS pos
 FROM (SELECT shape_id, unnest(rings) AS ring, generate_subscripts(rings, 1) AS ring_no
 FROM (SELECT shape_id, regexp_extract_all(geometry_wkt, '\(([^()]+)\)', 1) AS rings FROM a_shapes))))
 WINDOW w AS (PARTITION BY shape_id, ring_no ORDER BY pos)) WHERE x2 IS NOT NULL"""


def rule_case(rules: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN '{name}'" for name, test in rules) + " END"


FIRE_RULES = [
    ("bounds", f"NOT coalesce({inside('latitude', 'longitude')}, FALSE)"),
    ("format", "year IS NULL OR month IS NULL OR day IS NULL"),
    ("year", "year NOT BETWEEN 2022 AND 2025"),
    ("month", "month NOT BETWEEN 1 AND 12"),
    ("day", "day NOT BETWEEN 1 AND 31"),
    ("date", "TRY_CAST(printf('%04d-%02d-%02d', year, month, day) AS DATE) IS NULL"),
    ("size", "coalesce(size_ha, 0) NOT BETWEEN 0 AND 1000000"),
    (
        "geometry",
        "NOT (geometry_wkt IS NULL OR trim(geometry_wkt) = '' OR regexp_matches(upper(trim(geometry_wkt)),"
        " '^(MULTI)?(POINT|POLYGON|LINESTRING)'))",
    ),
]

STATION_FIELDS = """trim(substr(value, 1, 11)) AS station_id, TRY_CAST(trim(substr(value, 13, 8)) AS DOUBLE) AS latitude,
 TRY_CAST(trim(substr(value, 22, 9)) AS DOUBLE) AS longitude, TRY_CAST(trim(substr(value, 32, 6)) AS DOUBLE) AS raw_elevation,
 trim(substr(value, 42, 30)) AS name, substr(value, 1, 2) AS country"""
STATION_OUT = """station_id, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude,
 CASE WHEN raw_elevation <> -999.9 AND raw_elevation BETWEEN -100 AND 5000 THEN round(raw_elevation, 6) END AS elevation, name, country"""


def daily(mode: str) -> str:
    scaled = "CASE WHEN element = 'SNWD' THEN raw ELSE raw / 10.0e0 END"
    if mode == "tokens":
        days = r"""SELECT line_no, station_id, y, m, element, unnest(range(1, 1 + least(n_days, len(t) // 2))) AS dd, t FROM (
 SELECT *, string_split_regex(trim(tail), '\s+') AS t FROM v_daily_heads)"""
        picked = f"SELECT *, t[2 * dd - 1] AS raw_text, t[2 * dd] AS quality FROM ({days})"
        keep = "quality = 'C'"
    else:
        days = """SELECT line_no, station_id, y, m, element, tail,
 unnest(range(1, 1 + least(n_days, CAST(ceil(length(tail) / 8.0e0) AS BIGINT)))) AS dd FROM v_daily_heads"""
        picked = (
            "SELECT *, substr(tail, dd * 8 - 7, 5) AS raw_text, substr(tail, dd * 8 - 1, 1) AS q, substr(tail, dd * 8, 1)"
            f" AS quality FROM ({days})"
        )
        keep = "quality = 'C' AND trim(q) = ''"
    return f"""SELECT line_no, station_id, make_date(y, m, dd) AS date, element, value, quality FROM (
 SELECT *, {scaled} AS value FROM (SELECT *, TRY_CAST(trim(raw_text) AS DOUBLE) AS raw FROM ({picked})) WHERE {keep} AND raw <> -9999)
 WHERE CASE WHEN element IN ('PRCP', 'SNWD') THEN value BETWEEN 0 AND 500 ELSE value BETWEEN -60 AND 45 END"""


def wide(readings: str) -> str:
    last = ", ".join(f"arg_max(value, line_no) FILTER (element = '{m.upper()}') AS {m}" for m in MEASURES)
    flags = ", ".join(f"CASE WHEN {m} IS NOT NULL THEN 'C' END AS {m}_quality" for m in MEASURES)
    return f"SELECT *, {flags} FROM (SELECT station_id, date, {last} FROM {readings} GROUP BY station_id, date)"


def enriched(wide_view: str) -> str:
    present = " + ".join(f"CAST({m} IS NOT NULL AS INT)" for m in MEASURES)
    return f"""SELECT *, tmax - tmin AS temp_range, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month,
 CAST(dayofyear(date) AS INT) AS day_of_year, {season('month(date)')} AS season, ({present}) / 5.0e0 AS data_completeness
 FROM {wide_view}"""


def nearest_pairs(left: str, k: int) -> str:
    l1 = "abs(a.center_lat - b.center_lat) + abs(a.center_lon - b.center_lon)"
    return f"""SELECT * FROM (SELECT a.cell_id, b.cell_id AS neighbor_id, round({l1}, 9) AS degrees,
 CAST(row_number() OVER (PARTITION BY a.cell_id ORDER BY round({l1}, 9), b.cell_id) AS INT) AS rank
 FROM (SELECT * FROM v_cells WHERE cell_id IN (SELECT cell_id FROM {left})) a JOIN v_cells b ON a.cell_id <> b.cell_id)
 WHERE rank <= {k}"""


def dates_of(kind: str) -> str:
    n = DATES_PER_CELL[kind]
    w1, w2 = WATER_DATES[kind]
    return f"""SELECT cell_id, terrain_type, date AS target_date, CAST(draw AS INT) AS draw FROM (
 WITH land AS (SELECT cell_id, terrain_type, fire_count FROM v_targets WHERE terrain_type <> 'water'),
 avail AS (SELECT DISTINCT w.cell_id, w.date FROM v_cell_weather w JOIN land USING (cell_id)
   WHERE w.date BETWEEN DATE '2022-01-01' AND DATE '2024-12-31'),
 counted AS (SELECT cell_id, least({n}, count(*)) AS n FROM avail GROUP BY cell_id),
 fire_list AS (SELECT i.cell_id, a.date, row_number() OVER (PARTITION BY i.cell_id ORDER BY fire_start_date, fire_end_date, a.date) AS r
   FROM (SELECT DISTINCT cell_id, fire_start_date, fire_end_date FROM v_cell_fire) i JOIN land l ON i.cell_id = l.cell_id AND l.fire_count > 0
   JOIN avail a ON a.cell_id = i.cell_id AND a.date BETWEEN i.fire_start_date AND i.fire_end_date),
 burning AS (SELECT f.cell_id, f.date, f.r FROM fire_list f JOIN counted c ON f.cell_id = c.cell_id WHERE f.r <= c.n // 2),
 n_burning AS (SELECT cell_id, count(*) AS b FROM burning GROUP BY cell_id),
 shuffled AS (SELECT cell_id, date, row_number() OVER (PARTITION BY cell_id
   ORDER BY md5(concat_ws('|', cast(cell_id AS VARCHAR), cast(date AS VARCHAR), '42')), date) AS r FROM avail),
 rest AS (SELECT s.cell_id, s.date, s.r + coalesce(b.b, 0) AS r FROM shuffled s JOIN counted c ON s.cell_id = c.cell_id
   LEFT JOIN n_burning b ON s.cell_id = b.cell_id WHERE s.r <= c.n - coalesce(b.b, 0))
 SELECT l.cell_id, l.terrain_type, u.date, u.r AS draw FROM (SELECT * FROM burning UNION ALL SELECT * FROM rest) u JOIN land l ON l.cell_id = u.cell_id
 UNION ALL
 SELECT t.cell_id, t.terrain_type, d.date, d.r FROM v_targets t CROSS JOIN (SELECT CAST(g AS DATE) AS date,
   row_number() OVER (ORDER BY md5(concat_ws('|', cast(CAST(g AS DATE) AS VARCHAR), '42'))) AS r
   FROM generate_series(DATE '{w1}', DATE '{w2}', INTERVAL 1 DAY) t(g)) d WHERE t.terrain_type = 'water' AND d.r <= {n})"""


KEYS = """SELECT DISTINCT cell_id, target_date FROM {dates} WHERE terrain_type <> 'water'
 AND NOT (month(target_date) = 2 AND day(target_date) = 29)"""

# Weather rows with burning intervals joined to them, so that a day under two fires is two rows.
BURNING_WEATHER = """SELECT w.cell_id, w.date, w.tavg, w.tmax, w.prcp, CASE WHEN f.fire_id IS NOT NULL THEN 1 ELSE 0 END AS burning
 FROM v_cell_weather w LEFT JOIN v_cell_fire f ON w.cell_id = f.cell_id AND w.date BETWEEN f.fire_start_date AND f.fire_end_date"""


def yearly(keys: str) -> str:
    parts = []
    for b in (1, 2, 3):
        f = f"FILTER (back = {b})"
        parts.append(
            f"CASE WHEN count(*) {f} = 0 THEN 0 ELSE avg(tavg) {f} END AS year_{b}_avg_temp,"
            f" CASE WHEN count(*) {f} = 0 THEN 0 ELSE max(tmax) {f} END AS year_{b}_max_temp,"
            f" coalesce(sum(prcp) {f}, 0) AS year_{b}_total_precip,"
            f" CAST(count(*) FILTER (back = {b} AND prcp < 1) AS DOUBLE) AS year_{b}_dry_days,"
            f" CAST(coalesce(max(burning) {f}, 0) AS DOUBLE) AS year_{b}_fire_occurred"
        )
    names = [
        f"year_{b}_{x}" for b in (1, 2, 3) for x in ("avg_temp", "max_temp", "total_precip", "dry_days", "fire_occurred")
    ]
    filled = ", ".join(f"CASE WHEN g.cell_id IS NULL THEN 0 ELSE g.{n} END AS {n}" for n in names)
    return f"""SELECT *, CASE WHEN year_2_avg_temp IS NOT NULL THEN (year_3_avg_temp - year_1_avg_temp) / 2 END AS avg_temp_trend,
 (year_1_fire_occurred + year_2_fire_occurred + year_3_fire_occurred) / 3 AS fire_frequency, 0.0e0 AS avg_fire_size
 FROM (SELECT k.cell_id, k.target_date, {filled} FROM {keys} k LEFT JOIN (
 SELECT q.cell_id, q.target_date, {", ".join(parts)} FROM (SELECT *, make_date(year(target_date) - back, month(target_date), day(target_date)) AS mid
 FROM (SELECT *, unnest([1, 2, 3]) AS back FROM {keys})) q JOIN v_burning_weather b
 ON q.cell_id = b.cell_id AND b.date BETWEEN q.mid - 7 AND q.mid + 7 GROUP BY q.cell_id, q.target_date) g
 ON k.cell_id = g.cell_id AND k.target_date = g.target_date)"""


NEIGHBOR_NAMES = (
    "neighbor_avg_temp", "neighbor_max_temp", "neighbor_total_precip", "neighbor_dry_days", "neighbor_fire_frequency",
    "neighbor_terrain_types",
)


def around(keys: str) -> str:
    filled = ", ".join(f"CASE WHEN g.cell_id IS NULL THEN 0.0e0 ELSE g.{n} END AS {n}" for n in NEIGHBOR_NAMES)
    return f"""SELECT k.cell_id, k.target_date, {filled} FROM {keys} k LEFT JOIN (
 SELECT k.cell_id, k.target_date, avg(tmax) AS neighbor_avg_temp, max(tmax) AS neighbor_max_temp,
 coalesce(sum(prcp), 0) AS neighbor_total_precip, CAST(count(*) FILTER (prcp < 1) AS DOUBLE) AS neighbor_dry_days,
 avg(burning) AS neighbor_fire_frequency, 1.0e0 AS neighbor_terrain_types
 FROM {keys} k JOIN v_target_neighbors n ON k.cell_id = n.cell_id
 JOIN v_burning_weather b ON b.cell_id = n.neighbor_id AND b.date = k.target_date GROUP BY k.cell_id, k.target_date) g
 ON k.cell_id = g.cell_id AND k.target_date = g.target_date"""


def samples(kind: str) -> str:
    dates, keys, years, near = f"v_dates_{kind}", f"v_keys_{kind}", f"v_yearly_{kind}", f"v_around_{kind}"
    columns = []
    for c in C.FEATURE_COLUMNS:
        if c in ("elevation_m", "distance_to_urban_km", "is_water", "urban_flag"):
            water = {"elevation_m": "0.0e0", "distance_to_urban_km": "50.0e0", "is_water": "1.0e0", "urban_flag": "CAST(c.urban_flag AS DOUBLE)"}[c]
            columns.append(f"CASE WHEN d.terrain_type = 'water' THEN {water} END AS {c}")
        elif c.startswith("year_") or c in ("neighbor_avg_temp", "neighbor_max_temp", "neighbor_total_precip", "neighbor_fire_frequency"):
            source = "y" if c.startswith("year_") else "n"
            columns.append(f"CASE WHEN d.terrain_type = 'water' THEN 0.0e0 ELSE {source}.{c} END AS {c}")
        elif c in ("avg_temp_trend", "fire_frequency", "avg_fire_size"):
            columns.append(f"y.{c}")
        elif c in ("neighbor_dry_days", "neighbor_terrain_types"):
            columns.append(f"n.{c}")
        elif c == "area_km2":
            columns.append("100.0e0 AS area_km2")
        elif c == "historical_fire_frequency":
            columns.append("CASE WHEN d.terrain_type = 'water' THEN 0.0e0 ELSE f.historical_fire_frequency END AS historical_fire_frequency")
        else:
            columns.append(f"CASE WHEN d.terrain_type <> 'water' THEN f.{c} END AS {c}")
    return f"""SELECT d.cell_id, d.target_date, d.terrain_type, CASE WHEN EXISTS (SELECT 1 FROM v_cell_fire x WHERE x.cell_id = d.cell_id
 AND d.target_date BETWEEN x.fire_start_date AND x.fire_end_date) THEN 1 ELSE 0 END AS fire_occurred, {", ".join(columns)}
 FROM {dates} d JOIN v_cells c ON d.cell_id = c.cell_id JOIN v_cell_features f ON f.cell_id = d.cell_id
 LEFT JOIN {years} y ON y.cell_id = d.cell_id AND y.target_date = d.target_date
 LEFT JOIN {near} n ON n.cell_id = d.cell_id AND n.target_date = d.target_date
 WHERE d.terrain_type = 'water' OR NOT (month(d.target_date) = 2 AND day(d.target_date) = 29)"""


def by_terrain(values: dict) -> str:
    return "CASE terrain_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


_QUOTA = by_terrain(TARGET_QUOTA)

def targets_sql(least: dict[str, float]) -> str:
    return f"""WITH pool AS (SELECT cell_id, center_lat, center_lon, terrain_type, is_water, urban_flag, avg_confidence, data_days, fire_count
 FROM v_stats WHERE (terrain_type <> 'water' OR fire_count > 0) AND data_days >= 100 AND round(avg_confidence, 9) >= {by_terrain(least)}
 UNION ALL (SELECT cell_id, center_lat, center_lon, terrain_type, is_water, urban_flag, 0.0e0, 0, 0 FROM v_cells
 WHERE terrain_type = 'water' ORDER BY cell_id LIMIT 50)),
 available AS (SELECT terrain_type, count(*) FILTER (fire_count > 0) AS fires, count(*) FILTER (fire_count = 0) AS others FROM pool GROUP BY terrain_type),
 quota AS (SELECT terrain_type, least({_QUOTA} // 2, fires) AS n_fire, least({_QUOTA} - least({_QUOTA} // 2, fires), others) AS n_other FROM available),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY terrain_type, fire_count > 0
 ORDER BY md5(concat_ws('|', cast(cell_id AS VARCHAR), '42')), cell_id) AS n FROM pool)
 SELECT r.* EXCLUDE (n) FROM ranked r JOIN quota q ON r.terrain_type = q.terrain_type
 WHERE r.n <= CASE WHEN r.fire_count > 0 THEN q.n_fire ELSE q.n_other END"""


COMMON: dict[str, str] = {
    "v_stations": f"SELECT * FROM a_stations WHERE {inside('latitude', 'longitude')}",
    "v_readings": """SELECT * FROM a_readings WHERE value IS NOT NULL AND quality = 'C'
 AND CASE WHEN element IN ('PRCP', 'SNWD') THEN value BETWEEN 0 AND 500 ELSE value BETWEEN -60 AND 45 END""",
    "v_wide": wide("v_readings"),
    "v_weather": enriched("v_wide"),
    "v_station_rows": f"""SELECT {STATION_FIELDS}, {rule_case([
        ("short", "coalesce(length(trim(value)), 0) < 80"),
        ("format", "TRY_CAST(trim(substr(value, 13, 8)) AS DOUBLE) IS NULL OR TRY_CAST(trim(substr(value, 22, 9)) AS DOUBLE) IS NULL OR TRY_CAST(trim(substr(value, 32, 6)) AS DOUBLE) IS NULL"),
        ("bounds", "NOT " + inside("CAST(trim(substr(value, 13, 8)) AS DOUBLE)", "CAST(trim(substr(value, 22, 9)) AS DOUBLE)")),
    ])} AS reject FROM a_station_lines""",
    "v_inventory_rows": f"""SELECT *, {rule_case([
        ("short", "n_chars < 45"),
        ("format", "latitude IS NULL OR longitude IS NULL OR start_year IS NULL OR end_year IS NULL"),
        ("bounds", "NOT " + inside("latitude", "longitude")),
        ("years", "end_year < 2022 OR start_year > 2025"),
        ("element", f"parameter NOT IN ({ELEMENT_LIST})"),
    ])} AS reject FROM (SELECT trim(substr(value, 1, 11)) AS station_id, trim(substr(value, 32, 4)) AS parameter,
 TRY_CAST(trim(substr(value, 37, 4)) AS INT) AS start_year, TRY_CAST(trim(substr(value, 42, 4)) AS INT) AS end_year,
 TRY_CAST(trim(substr(value, 13, 8)) AS DOUBLE) AS latitude, TRY_CAST(trim(substr(value, 22, 9)) AS DOUBLE) AS longitude,
 length(trim(value)) AS n_chars FROM a_inventory_lines)""",
    "v_daily_heads": f"""SELECT line_no, trim(substr(value, 1, 11)) AS station_id, y, m, element, substr(value, 22) AS tail,
 day(last_day(make_date(y, m, 1))) AS n_days FROM (SELECT *, TRY_CAST(substr(value, 12, 4) AS INT) AS y,
 TRY_CAST(substr(value, 16, 2) AS INT) AS m, trim(substr(value, 18, 4)) AS element FROM a_daily_lines WHERE length(value) >= 34)
 WHERE y BETWEEN 2022 AND 2025 AND m BETWEEN 1 AND 12 AND element IN ({ELEMENT_LIST})""",
    "v_daily": daily("tokens"),
    "v_daily_wide": wide("v_daily"),
    "v_fire_rows": f"SELECT *, {rule_case(FIRE_RULES)} AS reject FROM a_fires",
    "v_fires": "SELECT *, coalesce(size_ha, 0) AS size0, make_date(year, month, day) AS fire_date FROM v_fire_rows WHERE reject IS NULL",
    "v_cells": full_grid(GRID_KM),
    "v_land": "SELECT * FROM v_cells WHERE terrain_type IN ('land', 'urban', 'forest')",
    "v_assigned": assigned("v_land"),
    "v_cell_weather": interpolated("v_assigned"),
    "v_ready_fires": """SELECT *, least(sqrt(size / pi()) / 10, 20.0e0) AS radius_km FROM (
 SELECT fire_id, line_no, latitude, longitude, TRY_CAST(rep_date AS DATE) AS start_date,
 CASE WHEN coalesce(out_date, '') IN ('', '0000/00/00') THEN TRY_CAST(rep_date AS DATE) ELSE TRY_CAST(out_date AS DATE) END AS end_date,
 CASE WHEN size0 > 0 THEN size0 ELSE 1.0e0 END AS size, CASE WHEN coalesce(fire_type, '') = '' THEN 'Unknown' ELSE fire_type END AS kind
 FROM v_fires) WHERE start_date IS NOT NULL AND end_date IS NOT NULL""",
    "v_hits": f"""SELECT * FROM (SELECT f.*, c.cell_id, {haversine('f.latitude', 'f.longitude', 'c.center_lat', 'c.center_lon')} AS km
 FROM v_ready_fires f CROSS JOIN v_land c) WHERE km <= radius_km""",
    "v_ready_files": """SELECT *, least(sqrt(size / pi()) / 10, 20.0e0) AS radius_km FROM (
 SELECT source_file, fire_id, line_no, latitude, longitude, TRY_CAST(rep_date AS DATE) AS start_date,
 CASE WHEN coalesce(out_date, '') IN ('', '0000/00/00') THEN TRY_CAST(rep_date AS DATE) ELSE TRY_CAST(out_date AS DATE) END AS end_date,
 CASE WHEN coalesce(size_ha, 0) > 0 THEN size_ha ELSE 1.0e0 END AS size FROM a_fire_files WHERE month BETWEEN 1 AND 12)""",
    "v_file_hits": f"""SELECT * FROM (SELECT f.*, c.cell_id, {haversine('f.latitude', 'f.longitude', 'c.center_lat', 'c.center_lon')} AS km
 FROM v_ready_files f CROSS JOIN v_land c) WHERE km <= radius_km""",
    "v_events": """SELECT fire_id, center_cell_id, start_date, end_date, size AS total_size_ha, kind AS fire_type, latitude, longitude,
 affected_cells FROM (SELECT *, row_number() OVER (PARTITION BY fire_id ORDER BY line_no) AS n FROM (
 SELECT line_no, fire_id, start_date, end_date, size, kind, latitude, longitude,
 concat('[', string_agg(cast(cell_id AS VARCHAR), ',' ORDER BY cell_id), ']') AS affected_cells,
 arg_min(cell_id, round(km, 6) * 1000000 * 10000 + cell_id) AS center_cell_id FROM v_hits GROUP BY ALL)) WHERE n = 1""",
    "v_cell_fire": """SELECT cell_id, fire_id, size / n_cells AS fire_size_ha, start_date AS fire_start_date, end_date AS fire_end_date
 FROM (SELECT *, count(*) OVER (PARTITION BY line_no) AS n_cells, row_number() OVER (PARTITION BY cell_id, fire_id ORDER BY line_no) AS n
 FROM v_hits) WHERE n = 1""",
    "v_stats": """SELECT c.*, w.avg_confidence, coalesce(w.data_days, 0) AS data_days, coalesce(f.fire_count, 0) AS fire_count FROM v_cells c
 LEFT JOIN (SELECT cell_id, avg(confidence_score) AS avg_confidence, count(DISTINCT date) AS data_days FROM v_cell_weather GROUP BY cell_id) w
 ON c.cell_id = w.cell_id LEFT JOIN (SELECT cell_id, count(DISTINCT fire_id) AS fire_count FROM v_cell_fire GROUP BY cell_id) f
 ON c.cell_id = f.cell_id""",
    "v_targets": targets_sql(CONFIDENCE_MIN),
    "v_land_targets": "SELECT cell_id FROM v_targets WHERE terrain_type <> 'water'",
    "v_target_neighbors": nearest_pairs("v_land_targets", 8),
    "v_burned_cells": "SELECT DISTINCT cell_id FROM v_cell_fire",
    "v_burning_weather": BURNING_WEATHER,
    "v_cell_features": f"""SELECT c.cell_id, CAST({by_terrain(TERRAIN_CODE)} AS DOUBLE) AS terrain_type_encoded, 100.0e0 AS area_km2,
 coalesce(n, 0) / 3.0e0 AS historical_fire_frequency, 0.0e0 AS elevation FROM v_cells c
 LEFT JOIN (SELECT cell_id, count(*) AS n FROM v_cell_fire GROUP BY cell_id) f ON c.cell_id = f.cell_id""",
    "v_regions": """SELECT station_id AS region_id, latitude - 0.5e0 AS lat_min, latitude + 0.5e0 AS lat_max, longitude - 1.0e0 AS lon_min,
 longitude + 1.0e0 AS lon_max FROM v_stations""",
    "v_region_cells": grid_sql("SELECT * FROM v_regions", 30.0),
    "v_edges": polygon_edges(),
    "v_losses": """SELECT model_id, avg(-CASE WHEN y = 1 THEN ln(q) ELSE ln(1 - q) END) AS loss FROM (
 SELECT *, least(greatest(p, 1e-15), 1 - 1e-15) AS q FROM a_scores) GROUP BY model_id""",
    "v_fitness": """SELECT m.model_id, loss + greatest(coalesce(mean_seconds, 0) - 1, 0) * 0.1e0 AS fitness
 FROM a_models m LEFT JOIN v_losses l ON m.model_id = l.model_id""",
    "v_best": "SELECT *, min(fitness) OVER (ORDER BY generation) AS best_fitness FROM a_generations",
}
for _kind in ("train", "test"):
    COMMON[f"v_dates_{_kind}"] = dates_of(_kind)
    COMMON[f"v_keys_{_kind}"] = KEYS.format(dates=f"v_dates_{_kind}")
    COMMON[f"v_yearly_{_kind}"] = yearly(f"v_keys_{_kind}")
    COMMON[f"v_around_{_kind}"] = around(f"v_keys_{_kind}")
    COMMON[f"v_samples_{_kind}"] = samples(_kind)


def rounded(columns: str | list[str], source: str, plain: str = "") -> str:
    names = columns.split() if isinstance(columns, str) else columns
    kept = [plain] if plain else []
    return f"SELECT {', '.join(kept + [f'round({n}, 6) AS {n}' for n in names])} FROM {source}"


_WEATHER_ROUND = "tmax tmin tavg temp_range prcp snwd data_completeness nearest_station_distance_km confidence_score"
_WEATHER_PLAIN = (
    "cell_id, CAST(date AS VARCHAR) AS date, year, month, day_of_year, season, interpolation_method, nearest_station_id, station_count_used"
)
_FLAGS = ", ".join(f"{m}_quality" for m in MEASURES)
_YEARLY_NAMES = [c for c in C.FEATURE_COLUMNS[:18]]
_KEY = "cell_id, CAST(target_date AS VARCHAR) AS target_date"
_CORNERS = [(BOX.lon_min, BOX.lat_min), (BOX.lon_min, BOX.lat_max), (BOX.lon_max, BOX.lat_min), (BOX.lon_max, BOX.lat_max)]
_SIDES = ", ".join(f"(x2 - x1) * ({cy} - y1) - (y2 - y1) * ({cx} - x1)" for cx, cy in _CORNERS)
_SAMPLE_JSON = ",".join(f'"{c}"' for c in C.SAMPLE_COLUMNS)

# Settings searched over, with the source's ranges and steps: low, high, step, whole number.
_SPACE = {
    "max_depth": (3, 15, 2, True), "n_estimators": (50, 500, 50, True), "learning_rate": (0.01, 0.3, 0.05, False),
    "subsample": (0.6, 1.0, 0.1, False), "colsample": (0.6, 1.0, 0.1, False),
}


def draw_sql(*parts: str) -> str:
    text = " || '|' || ".join(["'42'", *parts])
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0e0)"


def next_candidates_sql(generation: int) -> str:
    """Elite of five in the first slots; children of tournament winners (best of three drawn) in the other forty-five."""
    g, slot = f"'{generation}'", "CAST(slot AS VARCHAR)"
    cross, copy = f"{draw_sql(g, slot, chr(39) + 'cross' + chr(39))} < 0.8e0", f"{draw_sql(g, slot, chr(39) + 'copy' + chr(39))} < 0.5e0"
    columns = []
    for name, (low, high, step, whole) in _SPACE.items():
        q = f"'{name}'"
        u, v, w = (draw_sql(g, slot, q, f"'{x}'") for x in ("mix", "by", "move"))
        mixed = f"CASE WHEN {u} < 0.5e0 THEN a.{name} ELSE b.{name} END" if whole else f"a.{name} + {u} * (b.{name} - a.{name})"
        child = f"CASE WHEN {cross} THEN {mixed} WHEN {copy} THEN a.{name} ELSE b.{name} END"
        move = f"floor({v} * {2 * step + 1}) - {step}" if whole else f"({v} * 2 - 1) * {step}e0"
        moved = f"CASE WHEN {w} < 0.1e0 THEN least({high}, greatest({low}, {child} + {move})) ELSE {child} END"
        columns.append(f"round(CAST(CASE WHEN slot < 5 THEN o.{name} ELSE {moved} END AS DOUBLE), 6) AS {name}")
    winner = lambda side: (
        f"SELECT slot, min(r) AS r FROM (SELECT slot, r, row_number() OVER (PARTITION BY slot ORDER BY {draw_sql(g, slot, chr(39) + side + chr(39), 'CAST(r AS VARCHAR)')}, r) AS n"
        " FROM (SELECT unnest(range(50)) AS slot), (SELECT unnest(range(1, 6)) AS r)) WHERE n <= 3 GROUP BY slot"
    )
    elite = "SELECT *, row_number() OVER (ORDER BY fitness, model_id) AS r FROM a_population QUALIFY r <= 5"
    return (
        f"WITH elite AS ({elite}), wa AS ({winner('a')}), wb AS ({winner('b')})"
        f" SELECT CAST(wa.slot AS INT) AS slot, CASE WHEN wa.slot < 5 THEN o.model_id ELSE 'g{generation}-' || wa.slot END AS model_id, {', '.join(columns).replace('(slot', '(wa.slot').replace('WHEN slot', 'WHEN wa.slot')}"
        " FROM wa JOIN wb ON wa.slot = wb.slot JOIN elite a ON a.r = wa.r JOIN elite b ON b.r = wb.r LEFT JOIN elite o ON o.r = wa.slot + 1"
    )


ORACLES: dict[str, str] = {
    "station_scan": f"SELECT {STATION_OUT}, reject FROM v_station_rows",
    "station_scan_collector": f"""SELECT {STATION_OUT} FROM (SELECT {STATION_FIELDS} FROM a_station_lines WHERE length(value) >= 84)
 WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND raw_elevation IS NOT NULL AND {inside('latitude', 'longitude')} AND station_id LIKE 'CA%'""",
    "inventory_scan": rounded("latitude longitude", "v_inventory_rows", "station_id, parameter, start_year, end_year, reject"),
    "dly_tokens": rounded("value", "v_daily", "line_no, station_id, CAST(date AS VARCHAR) AS date, element, quality"),
    "dly_fixed": rounded("value", f"({daily('fixed')})", "line_no, station_id, CAST(date AS VARCHAR) AS date, element, quality"),
    "dly_year_filter": "SELECT line_no, value FROM a_daily_lines WHERE TRY_CAST(substr(value, 12, 4) AS INT) BETWEEN 2022 AND 2025",
    "year_audit": """SELECT CAST(substr(value, 12, 4) AS INT) AS year, count(*) AS n_records,
 CAST(CAST(substr(value, 12, 4) AS INT) NOT BETWEEN 2022 AND 2025 AS INT) AS out_of_range FROM a_daily_lines GROUP BY ALL""",
    "station_match": """WITH l AS (SELECT trim(substr(value, 1, 11)) AS station_id FROM a_daily_lines),
 s AS (SELECT DISTINCT station_id FROM v_station_rows WHERE reject IS NULL)
 SELECT station_id, count(*) AS n_lines, 1 AS known FROM l WHERE station_id IN (FROM s) AND station_id LIKE 'CA%' GROUP BY station_id
 UNION ALL SELECT DISTINCT station_id, 0, 0 FROM l WHERE station_id NOT IN (FROM s) AND station_id LIKE 'CA%'""",
    "weather_wide": rounded("tmax tmin tavg prcp snwd", "v_wide", f"station_id, CAST(date AS VARCHAR) AS date, {_FLAGS}"),
    "weather_enriched": rounded(
        "temp_range data_completeness", "v_weather", "station_id, CAST(date AS VARCHAR) AS date, year, month, day_of_year, season"
    ),
    "weather_wide_from_text": rounded(
        "tmax tmin tavg prcp snwd temp_range data_completeness",
        f"({enriched('v_daily_wide')})",
        f"station_id, CAST(date AS VARCHAR) AS date, {_FLAGS}, year, month, day_of_year, season",
    ),
    "variable_counts": " UNION ALL ".join(
        f"SELECT '{m}' AS column_name, count({m}) AS non_null, count(*) - count({m}) AS nulls FROM v_weather" for m in MEASURES
    ),
    "fire_rejects": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, coalesce(reject, 'valid') AS rule, count(*) AS n FROM {table} GROUP BY ALL"
        for name, table in (("wildfires", "v_fire_rows"), ("stations", "v_station_rows"), ("station_inventory", "v_inventory_rows"))
    ),
    "fire_sentinels": """SELECT fire_id AS NFDBFIREID, line_no, year AS YEAR, month AS MONTH, day AS DAY FROM a_fires
 WHERE year NOT IN (0, -9999) AND month NOT IN (0, -9999) AND day NOT IN (0, -9999) AND latitude IS NOT NULL AND longitude IS NOT NULL""",
    "processed_counts": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS processed, count(*) FILTER (reject IS NULL) AS valid, count(reject) AS removed FROM {table}"
        for name, table in (("wildfires", "v_fire_rows"), ("stations", "v_station_rows"))
    ),
    "reject_rows": "SELECT 'wildfires' AS table_name, line_no, reject, fire_id AS NFDBFIREID FROM v_fire_rows WHERE reject IS NOT NULL",
    "fire_valid": """SELECT fire_id AS NFDBFIREID, line_no, round(latitude, 6) AS LATITUDE, round(longitude, 6) AS LONGITUDE, year AS YEAR,
 month AS MONTH, day AS DAY, round(size0, 6) AS SIZE_HA, fire_type AS FIRE_TYPE, '' AS CAUSE, '' AS layer, geometry_wkt,
 CAST(fire_date AS VARCHAR) AS fire_date FROM v_fires""",
    "fire_polygon_box": f"""SELECT shape_id, CAST(bool_or(meets) OR count(*) FILTER (beyond) % 2 = 1 AS INT) AS meets FROM (
 SELECT shape_id, greatest(x1, x2) >= {BOX.lon_min} AND least(x1, x2) <= {BOX.lon_max} AND greatest(y1, y2) >= {BOX.lat_min}
 AND least(y1, y2) <= {BOX.lat_max} AND least({_SIDES}) <= 0 AND greatest({_SIDES}) >= 0 AS meets,
 CASE WHEN (y1 > {BOX.lat_min}) <> (y2 > {BOX.lat_min}) THEN x1 + ({BOX.lat_min} - y1) * (x2 - x1) / (y2 - y1) > {BOX.lon_min} ELSE FALSE END AS beyond
 FROM v_edges) GROUP BY shape_id""",
    "value_counts": """SELECT 'FIRE_TYPE' AS column_name, fire_type AS value, count(*) AS n FROM v_fires GROUP BY ALL
 UNION ALL SELECT 'YEAR', CAST(year AS VARCHAR), count(*) FROM v_fires GROUP BY ALL""",
    "range_profile": " UNION ALL ".join(
        f"SELECT '{c.upper()}' AS column_name, round(CAST(min({c}) AS DOUBLE), 6) AS low, round(CAST(max({c}) AS DOUBLE), 6) AS high FROM v_fires"
        for c in ("year", "latitude", "longitude")
    ),
    "station_pairs": f"""SELECT station_1, station_2, round(distance_km, 6) AS distance_km FROM (
 SELECT a.station_id AS station_1, b.station_id AS station_2, {euclid('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} * 111.32e0 AS distance_km
 FROM v_stations a JOIN v_stations b ON a.station_id <> b.station_id) WHERE distance_km < 500""",
    "station_neighbors": f"""SELECT station_id, neighbor_id, round(deg * 111.32e0, 6) AS distance_km, rank FROM (SELECT *,
 CAST(row_number() OVER (PARTITION BY station_id ORDER BY round(deg, 9), neighbor_id) AS INT) AS rank FROM (
 SELECT a.station_id, b.station_id AS neighbor_id, {euclid('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} AS deg
 FROM v_stations a JOIN v_stations b ON a.station_id <> b.station_id) WHERE deg * 111.32e0 < 500) WHERE rank <= 10""",
    "run_metadata": """SELECT 'stations_count' AS key, CAST(count(*) AS VARCHAR) AS value, 'stations inside the box' AS description, 1 AS written FROM v_stations
 UNION ALL SELECT 'fires_count', CAST(count(*) AS VARCHAR), 'fire reports', 0 FROM a_fires
 UNION ALL SELECT 'readings_count', CAST(count(*) AS VARCHAR), 'daily readings', 1 FROM a_readings""",
    "grid_cells": rounded("center_lat center_lon", "v_region_cells", "region_id, cell_id"),
    "terrain": f"""SELECT terrain_type, count(*) AS n_cells, CAST(sum(is_water) AS BIGINT) AS n_water_flag
 FROM (SELECT {terrain_columns()} FROM v_region_cells) GROUP BY terrain_type""",
    "cell_station": rounded(
        "dist_km primary_distance", "v_assigned", "cell_id, station_id, CAST(rnk AS INT) AS rnk, primary_station"
    ),
    "interp_idw": rounded(_WEATHER_ROUND, f"({interpolated('v_assigned')})", _WEATHER_PLAIN),
    "interp_nearest": rounded(_WEATHER_ROUND, f"({interpolated('v_assigned', 'nearest')})", _WEATHER_PLAIN),
    "interp_monthly": """SELECT cell_id, year, month, count(*) AS n_days, CAST(sum(station_count_used) AS BIGINT) AS n_reports,
 count(*) FILTER (interpolation_method = 'seasonal_default') AS n_default, round(avg(confidence_score), 6) AS mean_confidence,
 round(avg(tavg), 6) AS mean_tavg, round(sum(prcp), 6) AS total_prcp FROM v_cell_weather GROUP BY cell_id, year, month""",
    "seasonal_defaults": "SELECT station_id, CAST(date AS VARCHAR) AS date, season, "
    + ", ".join(f"round({default_of(m, 'month')}, 6) AS {m}" for m in MIXED)
    + " FROM v_weather WHERE tavg IS NULL",
    "weather_summary": """SELECT count(*) AS n_rows, count(DISTINCT cell_id) AS n_cells, count(DISTINCT date) AS n_dates,
 CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date FROM v_cell_weather""",
    "gbt_scores_valid": f"SELECT {_KEY}, fire_occurred, 1 AS is_probability, 1 AS is_same_when_loaded FROM v_samples_test",
    "model_features": f"""SELECT {_KEY}, s.fire_occurred, CAST(t.code AS DOUBLE) AS terrain_type_code, {', '.join(
        f'round(coalesce(CAST(s.{c} AS DOUBLE), 0), 6) AS {c}' for c in C.FEATURE_COLUMNS)} FROM v_samples_train s
 JOIN (SELECT terrain_type AS v, row_number() OVER (ORDER BY count(*) DESC, terrain_type) - 1 AS code FROM v_samples_train GROUP BY 1) t
 ON s.terrain_type = t.v""",
    "all_dates": "SELECT DISTINCT CAST(date AS VARCHAR) AS date FROM v_weather",
    "days_in_layouts": "SELECT line_no, layout, CASE WHEN layout < 7 THEN CAST(day AS VARCHAR) END AS day FROM a_day_texts",
    "fire_csv_layouts": """SELECT 'f0.csv' AS source_file, o_orderkey + 1 AS line_no, CAST(o_orderkey AS VARCHAR) AS LATITUDE,
 CAST(o_custkey AS VARCHAR) AS LONGITUDE, '2023' AS YEAR, '7' AS MONTH, '1' AS DAY, '1,5 ha' AS SIZE_HA, NULL AS CAUSE
 FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'f1.csv', o_orderkey + 1, CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), '2023', '7', '1',
 NULL, 'x' FROM orders WHERE o_orderkey % 3 = 1""",
    "fire_csv_records": """SELECT 'g0.csv' AS source_file, 2 * o_orderkey + 1 AS line_no, CAST(o_orderkey AS VARCHAR) AS LATITUDE,
 CAST(o_custkey AS VARCHAR) AS LONGITUDE, '1' AS SIZE_HA, CASE o_orderkey % 3 WHEN 0 THEN concat('struck "twice", then', chr(10), 'burned, slowly')
 WHEN 1 THEN 'a 5" hose' ELSE 'dry, windy' END AS cause FROM orders""",
    "fire_csv_left_open": "SELECT 'g1.csv' AS source_file, 'quote left open' AS reason",
    "fire_csv_skipped": """SELECT 'f2.csv' AS source_file, 'missing columns: LONGITUDE, YEAR, MONTH, DAY, SIZE_HA' AS reason""",
    "fire_events_of_files": """SELECT fire_id, center_cell_id, CAST(start_date AS VARCHAR) AS start_date, CAST(end_date AS VARCHAR) AS end_date,
 round(size, 6) AS total_size_ha, affected_cells FROM (SELECT *, row_number() OVER (PARTITION BY fire_id ORDER BY source_file, line_no) AS n FROM (
 SELECT source_file, line_no, fire_id, start_date, end_date, size, concat('[', string_agg(cast(cell_id AS VARCHAR), ',' ORDER BY cell_id), ']') AS affected_cells,
 arg_min(cell_id, round(km, 6) * 1000000 * 10000 + cell_id) AS center_cell_id FROM v_file_hits GROUP BY source_file, line_no, fire_id, start_date, end_date, size))
 WHERE n = 1""",
    "cell_fires_of_files": """SELECT cell_id, fire_id, round(size / n_cells, 6) AS fire_size_ha, CAST(start_date AS VARCHAR) AS fire_start_date,
 CAST(end_date AS VARCHAR) AS fire_end_date FROM (SELECT *, count(*) OVER (PARTITION BY source_file, line_no) AS n_cells,
 row_number() OVER (PARTITION BY cell_id, fire_id ORDER BY source_file, line_no) AS n FROM v_file_hits) WHERE n = 1""",
    "next_candidates": next_candidates_sql(3),
    "search_summary": """SELECT count(*) AS generations, round(min(best_fitness), 6) AS best_fitness, round(avg(generation / 10.0e0), 6) AS mean_seconds,
 concat('[', string_agg(CAST(best_fitness AS VARCHAR), ',' ORDER BY generation), ']') AS fitness_history FROM v_best""",
    "weather_dates": """SELECT CAST(date AS VARCHAR) AS date, count(*) AS n_stations FROM v_weather
 WHERE date IN (SELECT fire_date FROM v_fires) GROUP BY ALL""",
    "fire_events": """SELECT fire_id, center_cell_id, CAST(start_date AS VARCHAR) AS start_date, CAST(end_date AS VARCHAR) AS end_date,
 round(total_size_ha, 6) AS total_size_ha, fire_type, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, affected_cells FROM v_events""",
    "cell_fire_table": """SELECT cell_id, fire_id, round(fire_size_ha, 6) AS fire_size_ha, CAST(fire_start_date AS VARCHAR) AS fire_start_date,
 CAST(fire_end_date AS VARCHAR) AS fire_end_date FROM v_cell_fire""",
    "fire_summary": """SELECT count(*) AS n_events, round(sum(total_size_ha), 6) AS total_ha, (SELECT count(*) FROM v_cell_fire) AS n_relations,
 (SELECT count(DISTINCT cell_id) FROM v_cell_fire) AS n_cells FROM v_events""",
    "sample_fire_status": """SELECT k.cell_id, CAST(k.target_date AS VARCHAR) AS date, CASE WHEN EXISTS (SELECT 1 FROM v_cell_fire f
 WHERE f.cell_id = k.cell_id AND k.target_date BETWEEN f.fire_start_date AND f.fire_end_date) THEN 1 ELSE 0 END AS fire_occurred FROM v_keys_train k""",
    "fire_status": """SELECT b.cell_id, CAST(d.date AS VARCHAR) AS date, CASE WHEN EXISTS (SELECT 1 FROM v_cell_fire f WHERE f.cell_id = b.cell_id
 AND d.date BETWEEN f.fire_start_date AND f.fire_end_date) THEN 1 ELSE 0 END AS fire_occurred
 FROM v_burned_cells b CROSS JOIN (SELECT DISTINCT date FROM a_readings) d""",
    "fire_history_cells": "SELECT DISTINCT f.cell_id FROM v_cell_fire f JOIN v_events e ON f.fire_id = e.fire_id",
    "no_fire_cells": "SELECT cell_id, terrain_type FROM v_land WHERE cell_id NOT IN (SELECT cell_id FROM v_cell_fire)",
    "cell_stats": "SELECT cell_id, terrain_type, round(avg_confidence, 6) AS avg_confidence, data_days, fire_count FROM v_stats WHERE data_days >= 100",
    "target_cells_default": rounded(
        "avg_confidence", f"({targets_sql(LEAST_CONFIDENCE)})", "cell_id, terrain_type, is_water, urban_flag, data_days, fire_count"
    ),
    "target_cells": rounded("avg_confidence", "v_targets", "cell_id, terrain_type, is_water, urban_flag, data_days, fire_count"),
    "pool_cells": f"""SELECT cell_id, terrain_type, data_days, round(avg_confidence, 6) AS avg_confidence FROM (SELECT *,
 row_number() OVER (PARTITION BY terrain_type ORDER BY md5(concat_ws('|', cast(cell_id AS VARCHAR), '42')), cell_id) AS n
 FROM v_stats WHERE data_days >= 50) WHERE n <= {by_terrain({'forest': 2000, 'tundra': 1250, 'urban': 750, 'water': 1000})}""",
    "sample_dates": " UNION ALL ".join(
        f"SELECT cell_id, terrain_type, CAST(target_date AS VARCHAR) AS target_date, draw, '{k}' AS kind FROM v_dates_{k}" for k in ("train", "test")
    ),
    "cell_neighbors": rounded("degrees", f"({nearest_pairs('v_targets', 8)})", "cell_id, neighbor_id, rank"),
    "yearly_features": rounded(_YEARLY_NAMES, "v_yearly_train", _KEY),
    "neighbor_features": rounded(list(NEIGHBOR_NAMES), "v_around_train", _KEY),
    "cell_features": rounded("terrain_type_encoded area_km2 historical_fire_frequency elevation", "v_cell_features", "cell_id"),
    "training_samples": rounded(list(C.FEATURE_COLUMNS), "v_samples_train", f"{_KEY}, terrain_type, fire_occurred"),
    "samples_round_trip": rounded(list(C.FEATURE_COLUMNS), "v_samples_train", f"{_KEY}, terrain_type, fire_occurred"),
    "declared_tables": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS n_rows, 0 AS n_nulls, 0 AS n_repeats FROM {table}"
        for name, table in (
            ("stations", "v_stations"), ("grid_cells", f"({full_grid(GRID_KM)})"), ("cell_station", "v_assigned"), ("fire_events", "v_events"),
            ("cell_fire", "v_cell_fire"), ("station_neighbors", f"""(SELECT a.station_id, row_number() OVER (PARTITION BY a.station_id ORDER BY
 {euclid('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')}, b.station_id) AS place FROM v_stations a JOIN v_stations b
 ON a.station_id <> b.station_id AND {euclid('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} * 111.32e0 < 500) WHERE place <= 10"""),
        )
    ),
    "refused_overwrite": rounded("latitude longitude elevation", "v_stations", "station_id, name, country"),
    "csv_round_trip": """SELECT fire_id AS NFDBFIREID, line_no, round(latitude, 6) AS LATITUDE, year AS YEAR, fire_type AS FIRE_TYPE, geometry_wkt,
 CASE line_no % 6 WHEN 0 THEN '' WHEN 1 THEN 'say "x", then y' WHEN 2 THEN concat('two', chr(10), 'lines') WHEN 3 THEN concat('  blanks ', chr(92), ' ')
 WHEN 4 THEN '"' END AS REMARK FROM a_fires""",
    "dataset_metadata": f"""SELECT concat('{{"training_samples":', (SELECT count(*) FROM v_samples_train), ',"test_samples":',
 (SELECT count(*) FROM v_samples_test), ',"features":[{_SAMPLE_JSON}],"terrain_distribution":{{',
 (SELECT string_agg(concat('"', k, '":', n), ',' ORDER BY k) FROM (SELECT terrain_type AS k, count(*) AS n FROM v_samples_train GROUP BY 1)),
 '}},"fire_distribution":{{',
 (SELECT string_agg(concat('"', k, '":', n), ',' ORDER BY k) FROM (SELECT fire_occurred AS k, count(*) AS n FROM v_samples_train GROUP BY 1)),
 '}}}}') AS metadata""",
    "feature_profile": " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, count(*) - count({c}) AS nulls,"
        f" CAST(count(DISTINCT {c}) <= 1 AS INT) AS constant FROM v_samples_train"
        for c in C.FEATURE_COLUMNS
    ),
    "class_balance": """SELECT total, positives, total - positives AS negatives, round(positives / total, 6) AS fire_rate,
 CASE WHEN positives / total < 0.05 THEN 'low' WHEN positives / total > 0.5 THEN 'high' ELSE 'ok' END AS balance,
 round(least((total - positives) / positives, 5.0e0), 6) AS positive_weight
 FROM (SELECT count(*) AS total, count(*) FILTER (fire_occurred = 1) AS positives FROM a_labelled)""",
    "pool_summary": """SELECT coalesce(terrain_type, 'all') AS terrain_type, count(*) AS n_rows, CAST(sum(fire_occurred) AS BIGINT) AS n_fires,
 CAST(min(target_date) AS VARCHAR) AS first_date, CAST(max(target_date) AS VARCHAR) AS last_date, round(sum(fire_occurred) / count(*), 6) AS fire_rate,
 round(count(*) / (SELECT count(*) FROM a_labelled), 6) AS terrain_share FROM a_labelled GROUP BY GROUPING SETS ((terrain_type), ())""",
    "split_8020": """SELECT doc_id, quality, CAST(row_number() OVER (PARTITION BY quality ORDER BY md5(concat_ws('|', cast(doc_id AS VARCHAR), '42')), doc_id)
 <= floor(count(*) OVER (PARTITION BY quality) * 0.2e0 + 0.5e0) AS INT) AS is_test FROM a_graded""",
    "generation_subset": """SELECT sample_id, cell_id, CAST(target_date AS VARCHAR) AS target_date, terrain_type, fire_occurred FROM a_labelled
 ORDER BY md5(concat_ws('|', cast(sample_id AS VARCHAR), '3')), sample_id LIMIT 200""",
    "model_metrics": """WITH g AS (SELECT model_id, p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM a_scores GROUP BY model_id, p),
 a AS (SELECT model_id, sum(pos * (below + neg / 2.0e0)) / (sum(pos) * sum(neg)) AS roc_auc FROM (SELECT *,
 coalesce(sum(neg) OVER (PARTITION BY model_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) GROUP BY model_id),
 c AS (SELECT model_id, count(*) AS n_rows, count(*) FILTER (y = 1 AND p > 0.5) AS tp, count(*) FILTER (p > 0.5) AS called, count(*) FILTER (y = 1) AS pos
 FROM a_scores GROUP BY model_id)
 SELECT c.model_id, n_rows, round(loss, 6) AS log_loss, round(coalesce(tp / nullif(called, 0), 0), 6) AS precision,
 round(coalesce(tp / nullif(pos, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(called + pos, 0), 0), 6) AS f1_score,
 round(pos / n_rows, 6) AS fire_rate, round(coalesce(roc_auc, 0.5), 6) AS roc_auc
 FROM c JOIN a ON c.model_id = a.model_id JOIN v_losses l ON l.model_id = c.model_id""",
    "baseline_scores": f"""WITH f AS (SELECT sum(fire_occurred) AS fs, count(*) AS fn FROM a_labelled WHERE terrain_type = 'forest'),
 o AS (SELECT cell_id, sum(fire_occurred) AS s, count(*) AS n FROM a_labelled WHERE terrain_type <> 'forest' GROUP BY cell_id)
 SELECT request_id, r.cell_id, CAST(target_date AS VARCHAR) AS target_date, round(least(0.95e0, greatest(0.05e0,
 (fs + coalesce(s, 0)) / (fn + coalesce(n, 0)) * (1 + 0.3e0 * {wave('month(target_date)', 6)}))), 6) AS fire_probability, 0.8e0 AS confidence
 FROM a_requests r CROSS JOIN f LEFT JOIN o ON r.cell_id = o.cell_id""",
    "population_fitness": rounded("fitness", "v_fitness", "model_id"),
    "elite": "SELECT model_id, round(fitness, 6) AS fitness FROM v_fitness WHERE fitness IS NOT NULL ORDER BY v_fitness.fitness, model_id LIMIT 3",
    "best_history": rounded("fitness best_fitness", "v_best", "generation"),
    "convergence": """SELECT generation, round(fitness, 6) AS fitness, round(best_fitness, 6) AS best_fitness,
 CAST(count(*) OVER w = 3 AND min(round(best_fitness, 4)) OVER w = max(round(best_fitness, 4)) OVER w AS INT) AS converged
 FROM v_best WINDOW w AS (ORDER BY generation ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
}


def build(name: str) -> str:
    """One statement: the query with the views it needs as common table expressions, in order."""
    known = {**{n: _duckdb_text(n) for n in VIEWS}, **COMMON}
    order: list[str] = []

    def visit(text: str) -> None:
        for word in re.findall(r"\b[av]_\w+\b", text):
            if word in known and word not in order:
                visit(known[word])
                if word not in order:
                    order.append(word)

    visit(ORACLES[name])
    if not order:
        return ORACLES[name]
    views = ",\n".join(f"{n} AS MATERIALIZED ({known[n]})" for n in order)
    text = ORACLES[name]
    if text.startswith("WITH "):
        return f"WITH {views},\n{text[5:]}"
    return f"WITH {views}\n{text}"


def _duckdb_text(name: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql_of(name, "duckdb"))


def all_oracles() -> dict[str, str]:
    return {name: build(name) for name in ORACLES}
