"""Weather, fire and score tables derived from the test tables.

The test data holds no weather, so the registered queries read it through these views. Each view is one SQL text that runs
unchanged in Spark and in DuckDB (two texts where the lambda syntax differs); names in braces are tables or other views.
Number literals carry an exponent so that both engines read them as doubles.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession

from emberline.session import reliable_cut

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

_DAY_TEXT = """CASE WHEN (p_partkey + d) % 11 = 0 THEN '-9999   ' WHEN (p_partkey + d) % 13 = 0 THEN '    0T C'
 WHEN (p_partkey + d) % 17 = 0 THEN ' -250 IC'
 ELSE concat(lpad(cast((p_partkey * d) % 900 - 300 AS string), 5, ' '), '  C') END"""


def _daily_lines(days: str) -> str:
    return f"""SELECT p_partkey AS line_no,
 concat('CA', lpad(cast(p_partkey % 100 AS string), 9, '0'), cast(2021 + p_partkey % 6 AS string),
 lpad(cast(1 + p_partkey % 12 AS string), 2, '0'),
 CASE p_partkey % 7 WHEN 0 THEN 'TMAX' WHEN 1 THEN 'TMIN' WHEN 2 THEN 'TAVG' WHEN 3 THEN 'PRCP' WHEN 4 THEN 'SNWD'
 WHEN 5 THEN 'WT01' ELSE 'TMAX' END, {days}) AS value FROM {{part}}"""


def _ring(points: list[tuple[str, str]]) -> str:
    parts = []
    for i, (x, y) in enumerate(points):
        parts += ["', '" if i else "'('", f"cast({x} AS string)", "' '", f"cast({y} AS string)"]
    return ", ".join(parts + ["')'"])


_TRIANGLE = [("x - h", "y - h"), ("x + h", "y - h"), ("x", "y + h"), ("x - h", "y - h")]
_SQUARE = [("x - h", "y - h"), ("x + h", "y - h"), ("x + h", "y + h"), ("x - h", "y + h"), ("x - h", "y - h")]
_HOLE = [("x - g", "y - g"), ("x + g", "y - g"), ("x + g", "y + g"), ("x - g", "y + g"), ("x - g", "y - g")]
_FAR = [("x + 40e0", "y"), ("x + 41e0", "y"), ("x + 41e0", "y + 1e0"), ("x + 40e0", "y")]

VIEWS: dict[str, str | dict[str, str]] = {
    # Stations: a position grid over and around the study area.
    "a_stations": """SELECT concat('CA', lpad(cast(s_suppkey AS string), 9, '0')) AS station_id,
 40.0e0 + (s_suppkey * 37 % 220) / 10.0e0 AS latitude, -140.0e0 + (s_suppkey * 61 % 900) / 10.0e0 AS longitude,
 s_acctbal AS elevation, s_name AS name, 'CA' AS country FROM {supplier}""",
    # Daily readings, several per station, day and element; line_no orders them.
    "a_readings": """SELECT concat('CA', lpad(cast(l_suppkey AS string), 9, '0')) AS station_id,
 date '2021-01-01' + cast((l_orderkey * 7 + l_partkey) % 1461 AS int) AS date,
 CASE (l_linenumber * 3 + l_partkey) % 5 WHEN 0 THEN 'TMAX' WHEN 1 THEN 'TMIN' WHEN 2 THEN 'TAVG' WHEN 3 THEN 'PRCP'
 ELSE 'SNWD' END AS element,
 CASE (l_linenumber * 3 + l_partkey) % 5 WHEN 1 THEN l_quantity - 40.0e0 ELSE l_quantity END AS value,
 CASE WHEN l_returnflag = 'R' THEN 'I' ELSE 'C' END AS quality,
 (l_orderkey * 10 + l_linenumber) * 100000 + cast(floor(l_extendedprice) AS bigint) % 100000 AS line_no FROM {lineitem}""",
    # Fire reports with every kind of fault.
    "a_fires": """SELECT concat('F', cast(o_orderkey - CASE WHEN o_orderkey % 15 = 0 THEN 1 ELSE 0 END AS string)) AS fire_id,
 o_orderkey AS line_no, 41.0e0 + (o_custkey * 53 % 200) / 10.0e0 AS latitude,
 -139.0e0 + (o_orderkey * 29 % 880) / 10.0e0 AS longitude,
 cast(2021 + o_orderkey % 6 AS int) AS year, cast(o_custkey % 14 AS int) AS month, cast(o_orderkey % 33 AS int) AS day,
 CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN -1.0e0
 WHEN o_orderkey % 23 = 0 THEN o_totalprice * 40.0e0 WHEN o_orderkey % 2 = 0 THEN o_totalprice * 0.5e0
 ELSE o_totalprice / 20.0e0 END AS size_ha,
 cast(date '2022-01-01' + cast(o_orderkey % 1096 AS int) AS string) AS rep_date,
 CASE WHEN o_custkey % 7 = 0 THEN NULL WHEN o_custkey % 11 = 0 THEN '0000/00/00'
 ELSE cast(date '2022-01-01' + cast(o_orderkey % 1096 + o_custkey % 20 AS int) AS string) END AS out_date,
 CASE WHEN o_orderpriority LIKE '5%' THEN '' ELSE o_orderpriority END AS fire_type,
 CASE o_orderkey % 4 WHEN 0 THEN 'POINT (1 2)' WHEN 1 THEN '' WHEN 2 THEN NULL
 ELSE CASE WHEN o_custkey % 3 = 0 THEN 'CIRCLE (1 2)' ELSE ' polygon ((0 0, 1 0, 1 1, 0 0))' END END AS geometry_wkt
 FROM {orders}""",
    # Fire perimeters: triangles, squares with a hole, two-part shapes; some wrap the whole area.
    "a_shapes": f"""SELECT c_custkey AS shape_id, CASE
 WHEN kind = 0 THEN concat('POLYGON (', {_ring(_TRIANGLE)}, ')')
 WHEN kind = 1 THEN concat('POLYGON (', {_ring(_SQUARE)}, ', ', {_ring(_HOLE)}, ')')
 ELSE concat('MULTIPOLYGON ((', {_ring(_TRIANGLE)}, '), (', {_ring(_FAR)}, '))') END AS geometry_wkt
 FROM (SELECT c_custkey, c_custkey % 3 AS kind, 35.0e0 + (c_custkey * 37 % 120) / 4.0e0 AS y,
 -150.0e0 + (c_custkey * 61 % 440) / 4.0e0 AS x,
 CASE WHEN c_custkey % 10 = 0 THEN 150.0e0 ELSE 0.5e0 + (c_custkey % 24) / 4.0e0 END AS h,
 CASE WHEN c_custkey % 20 = 0 THEN 120.0e0 ELSE 0.25e0 END AS g FROM {{customer}}) AS t""",
    # Station and inventory lines in fixed width.
    "a_station_lines": """SELECT concat(station_id, ' ', lpad(cast(latitude AS string), 8, ' '), ' ',
 lpad(cast(longitude AS string), 9, ' '), ' ',
 CASE WHEN elevation < 0 THEN '-999.9' ELSE lpad(cast(cast(floor(elevation) AS int) AS string), 6, ' ') END, '    ',
 rpad(name, 30, ' '), ' GSN     ', CASE WHEN latitude < 45 THEN '     ' ELSE '71000' END) AS value FROM {a_stations}""",
    "a_inventory_lines": """SELECT concat(station_id, ' ', lpad(cast(latitude AS string), 8, ' '), ' ',
 lpad(cast(longitude AS string), 9, ' '), ' ',
 CASE WHEN latitude < 45 THEN 'WT01' WHEN latitude < 52 THEN 'TMAX' ELSE 'PRCP' END, ' ',
 CASE WHEN longitude < -100 THEN '1990 2023' ELSE '1950 2020' END) AS value FROM {a_stations}""",
    # Daily lines, with missing marks that lack flags, glued values, trace marks and failed checks.
    "a_daily_lines": {
        "spark": _daily_lines(f"array_join(transform(sequence(1, 31), d -> {_DAY_TEXT}), '')"),
        "duckdb": _daily_lines(f"array_to_string(list_transform(range(1, 32), lambda d: {_DAY_TEXT}), '')"),
    },
    # Scores of five models, and the prediction times of seven (two have no scores).
    "a_scores": """SELECT user_id % 5 AS model_id, CASE WHEN event_id % 10 < 3 THEN 1 ELSE 0 END AS y,
 least(0.99e0, greatest(0.01e0, value / 100.0e0 + CASE WHEN event_id % 10 < 3 THEN 0.1e0 ELSE 0.0e0 END)) AS p
 FROM {events}""",
    "a_models": """SELECT user_id % 7 AS model_id, avg(value) / 20.0e0 AS mean_seconds FROM {events} GROUP BY user_id % 7""",
    "a_generations": """SELECT cast(event_id % 200 AS int) AS generation, round(avg(value), 2) AS fitness FROM {events}
 GROUP BY cast(event_id % 200 AS int)""",
    # A ranked population of settings, and a history of generations.
    "a_population": """SELECT concat('m', cast(s_suppkey AS string)) AS model_id, s_acctbal AS fitness,
 cast(3 + s_suppkey * 7 % 13 AS double) AS max_depth, cast(50 + s_suppkey * 37 % 451 AS double) AS n_estimators,
 0.01e0 + (s_suppkey * 11 % 30) / 100.0e0 AS learning_rate, 0.6e0 + (s_suppkey * 13 % 41) / 100.0e0 AS subsample,
 0.6e0 + (s_suppkey * 17 % 41) / 100.0e0 AS colsample FROM {supplier}""",
    # Fire reports as two files whose lines have the same numbers, some reports standing in both.
    "a_fire_files": """SELECT f.*, 'b.csv' AS source_file FROM {a_fires} AS f WHERE line_no % 3 < 2 UNION ALL
 SELECT fire_id, line_no, latitude, longitude, year, month, day, size_ha * 0.5e0 AS size_ha, rep_date, out_date, fire_type, geometry_wkt,
 'a.csv' AS source_file FROM {a_fires} WHERE line_no % 3 > 0""",
    # Days in several layouts, some of them no days.
    "a_day_texts": """SELECT o_orderkey AS line_no, cast(o_orderdate AS date) AS day, o_orderkey % 9 AS layout,
 cast(extract(year FROM cast(o_orderdate AS date)) AS string) AS y, cast(extract(month FROM cast(o_orderdate AS date)) AS string) AS m,
 cast(extract(day FROM cast(o_orderdate AS date)) AS string) AS d FROM {orders}""",
    "a_days": """SELECT line_no, day, layout, CASE layout WHEN 0 THEN concat(y, '-', lpad(m, 2, '0'), '-', lpad(d, 2, '0'))
 WHEN 1 THEN concat(y, '/', lpad(m, 2, '0'), '/', lpad(d, 2, '0')) WHEN 2 THEN concat(y, '-', m, '-', d)
 WHEN 3 THEN concat(y, lpad(m, 2, '0'), lpad(d, 2, '0')) WHEN 4 THEN concat(m, '/', d, '/', y)
 WHEN 5 THEN concat(' ', y, '-', lpad(m, 2, '0'), '-', lpad(d, 2, '0'), ' 10:20:30')
 WHEN 6 THEN concat(y, '-', lpad(m, 2, '0'), '-', lpad(d, 2, '0'), 'T01:02:03.5Z')
 WHEN 7 THEN concat(y, '-', lpad(m, 2, '0'), '-', lpad(d, 2, '0'), 'x') ELSE concat(y, '-13-', d) END AS text FROM {a_day_texts}""",
    # CSV lines of three files in two readable layouts and one that lacks a column; line 0 is the header.
    "a_csv_lines": """SELECT concat('f', cast(o_orderkey % 3 AS string), '.csv') AS source_file, o_orderkey + 1 AS line_no,
 CASE o_orderkey % 3 WHEN 0 THEN concat(cast(o_orderkey AS string), ',', cast(o_custkey AS string), ',2023,7,1,', '"1,5 ha"')
 WHEN 1 THEN concat('1,7,2023,', cast(o_orderkey AS string), ',', cast(o_custkey AS string), ',,x') ELSE 'a,b' END AS value FROM {orders}
 UNION ALL SELECT 'f0.csv', 0, 'LATITUDE,LONGITUDE,YEAR,MONTH,DAY,SIZE_HA' FROM {region} WHERE r_regionkey = 0
 UNION ALL SELECT 'f1.csv', 0, 'DAY,MONTH,YEAR,LATITUDE,LONGITUDE,SIZE_HA,CAUSE' FROM {region} WHERE r_regionkey = 0
 UNION ALL SELECT 'f2.csv', 0, 'LATITUDE,CAUSE' FROM {region} WHERE r_regionkey = 0""",
    # CSV lines with quoted line breaks: a header over two lines, records over one and two, and a file that ends inside quotes.
    "a_csv_breaks": """SELECT 'g0.csv' AS source_file, 2 * o_orderkey + 1 AS line_no, concat(cast(o_orderkey AS string), ',', cast(o_custkey AS string),
 ',2023,7,1,1,', CASE o_orderkey % 3 WHEN 0 THEN '"struck ""twice"", then' WHEN 1 THEN 'a 5" hose' ELSE '"dry, windy"' END) AS value FROM {orders}
 UNION ALL SELECT 'g0.csv', 2 * o_orderkey + 2, 'burned, slowly"' FROM {orders} WHERE o_orderkey % 3 = 0
 UNION ALL SELECT 'g0.csv', -1, 'LATITUDE,LONGITUDE,YEAR,MONTH,DAY,SIZE_HA,"CAUSE' FROM {region} WHERE r_regionkey = 0
 UNION ALL SELECT 'g0.csv', 0, 'TEXT"' FROM {region} WHERE r_regionkey = 0
 UNION ALL SELECT 'g1.csv', o_orderkey + 2, '1,2,2023,7,1,1' FROM {orders}
 UNION ALL SELECT 'g1.csv', 1, '1,2,2023,7,1,"1' FROM {region} WHERE r_regionkey = 0
 UNION ALL SELECT 'g1.csv', 0, 'LATITUDE,LONGITUDE,YEAR,MONTH,DAY,SIZE_HA' FROM {region} WHERE r_regionkey = 0""",
    # Labelled samples and prediction requests.
    "a_labelled": """SELECT o_orderkey AS sample_id, o_custkey AS cell_id, cast(o_orderdate AS date) AS target_date,
 CASE o_orderkey % 5 WHEN 0 THEN 'forest' WHEN 1 THEN 'land' WHEN 2 THEN 'urban' WHEN 3 THEN 'water' ELSE 'forest' END
 AS terrain_type, CASE WHEN (o_orderkey * 7 + o_custkey) % 9 = 0 THEN 1 ELSE 0 END AS fire_occurred FROM {orders}""",
    "a_requests": """SELECT event_id AS request_id, user_id AS cell_id, cast(ts AS date) AS target_date FROM {events}""",
    "a_graded": """SELECT d.doc_id, l.quality, d.n_chars FROM {documents} AS d JOIN {labels} AS l ON d.doc_id = l.doc_id""",
}


# Views that make much text of a few bytes a row, with the rows for one task. Spark cuts a table into tasks by its bytes, which would leave
# all of the text to one task.
ROWS_PER_TASK = {"a_daily_lines": 10_000}


def sql_of(name: str, engine: str) -> str:
    text = VIEWS[name]
    return text if isinstance(text, str) else text[engine]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a derived view as a DataFrame."""
    if name in BASE_TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = sql_of(name, "spark")
    inputs = {n: view(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", text))}
    if name not in ROWS_PER_TASK:
        return spark.sql(text, **inputs)
    spread = {n: df.repartition(max(1, math.ceil(df.count() / ROWS_PER_TASK[name]))) for n, df in inputs.items()}
    # Stored, as a filter on the lines would otherwise make them before they are spread, and once more for every column cut out of them.
    return reliable_cut(spark.sql(text, **spread), name)
