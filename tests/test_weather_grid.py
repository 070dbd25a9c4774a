import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from emberline import config as C
from emberline.functions import exprs as X
from emberline.operators import fires, interpolate as ip, weather

DAY = dt.date(2023, 7, 14)


def wide(spark, *readings):
    """(station, day, tmax, tmin) rows as enriched station weather."""
    df = spark.createDataFrame(list(readings), "station_id string, date date, tmax double, tmin double")
    return weather.enrich(df)


def test_last_reading_wins(spark):
    readings = spark.createDataFrame(
        [("A", DAY, "TMAX", 10.0, "C", 1), ("A", DAY, "TMAX", 20.0, "C", 3), ("A", DAY, "TMAX", 30.0, "I", 4),
         ("A", DAY, "TMAX", 99.0, "C", 5), ("A", DAY, "PRCP", 0.0, "C", 2), ("A", DAY, "WT01", 1.0, "C", 6)],
        "station_id string, date date, element string, value double, quality string, line_no long",
    )
    out = weather.enrich(weather.weather_wide(weather.accept_readings(readings))).first()
    assert (out.tmax, out.prcp, out.tmin, out.tmax_quality, out.tmin_quality) == (20.0, 0.0, None, "C", None)
    assert (out.temp_range, out.season, out.day_of_year, out.data_completeness) == (None, "summer", 195, 0.4)


def test_missing_columns_are_added(spark):
    out = wide(spark, ("A", DAY, 20.0, 12.5)).first()
    assert (out.temp_range, out.snwd, out.snwd_quality, out.data_completeness) == (7.5, None, None, 0.4)


MONTHS = {
    1: ("winter", -2.9904, 0.0096, -5.9904, 6.0, 1.5, 5.0), 2: ("winter", 2.5, 4.7679, 0.2321, 4.5359, 1.134, 8.6603),
    3: ("spring", 10.0, 12.0, 8.0, 4.0, 1.0, 10.0), 6: ("summer", 25.0, 29.0, 21.0, 8.0, 2.0, 0.0),
    11: ("fall", -2.9904, 2.0096, -7.9904, 10.0, 2.5, 0.0), 12: ("winter", -5.0, -1.0, -9.0, 8.0, 2.0, 0.0),
}


def test_seasonal_defaults(spark):
    values = X.seasonal_defaults("m")
    names = ("tavg", "tmax", "tmin", "temp_range", "prcp", "snwd")
    df = spark.createDataFrame([(m,) for m in MONTHS], "m int")
    found = df.select("m", X.season("m").alias("s"), *[F.round(values[n], 4).alias(n) for n in names]).collect()
    for r in found:
        assert (r.s, *[getattr(r, n) for n in names]) == pytest.approx(MONTHS[r.m])


def assignment(spark, *rows_):
    """(cell, station, km) rows, nearest first."""
    nearest = {}
    for cell, station, km in rows_:
        nearest.setdefault(cell, (station, km))
    full, seen = [], {}
    for cell, station, km in rows_:
        seen[cell] = seen.get(cell, 0) + 1
        full.append((cell, station, km, seen[cell], *nearest[cell]))
    return spark.createDataFrame(
        full, "cell_id long, station_id string, dist_km double, rnk int, primary_station string, primary_distance double"
    )


def test_inverse_distance_weights(spark):
    cells = assignment(spark, (1, "A", 100.0), (1, "B", 150.0), (1, "C", 180.0))
    data = wide(spark, ("A", DAY, 10.0, 1.0), ("B", DAY, 20.0, 1.0), ("C", DAY, 30.0, None))
    for bound in (None, 1):
        out = ip.interpolate(cells, data, cell_bound=bound).first()
        assert out.tmax == pytest.approx(16.056338, abs=1e-6)
        assert out.tmin is None and out.temp_range is None and out.tavg is None
        assert (out.station_count_used, out.confidence_score) == (3, 0.5)
        assert (out.interpolation_method, out.nearest_station_id) == ("distance_weighted", "A")


def test_one_reporting_station_and_none(spark):
    cells = assignment(spark, (1, "A", 60.0), (1, "B", 90.0), (2, "Z", 0.0))
    other = DAY + dt.timedelta(days=1)
    data = wide(spark, ("B", DAY, 20.0, None), ("Z", other, 5.0, 1.0))
    out = {(r.cell_id, r.date): r for r in ip.interpolate(cells, data).collect()}
    assert len(out) == 4
    only_second = out[1, DAY]
    # Values come from the station that reports, identity and confidence from the primary one.
    assert (only_second.tmax, only_second.nearest_station_id, only_second.nearest_station_distance_km) == (20.0, "A", 60.0)
    assert only_second.confidence_score == pytest.approx(0.4) and only_second.interpolation_method == "nearest_station"
    nothing = out[1, other]
    assert (nothing.interpolation_method, nothing.station_count_used, nothing.nearest_station_id) == ("seasonal_default", 0, None)
    assert nothing.tmax == pytest.approx(27.990381, abs=1e-6) and nothing.confidence_score == 0.1
    assert (out[2, other].tmax, out[2, other].confidence_score) == (5.0, 1.0)
    nearest = {(r.cell_id, r.date): r.interpolation_method for r in ip.interpolate(cells, data, "nearest").collect()}
    assert nearest[1, DAY] == "seasonal_default" and nearest[2, other] == "nearest_station"
    with pytest.raises(ValueError):
        ip.interpolate(cells, data, "kriging")


@pytest.mark.parametrize("km, tier", [(49.9, 1), (50.0, 3), (199.9, 3), (200.0, 5), (700.0, 5)])
def test_tiers(spark, km, tier):
    degrees = km / 111.194926644
    cells = spark.createDataFrame([(1, 45.0, -100.0)], "cell_id long, center_lat double, center_lon double")
    stations = spark.createDataFrame(
        [(f"S{i:02d}", 45.0 + degrees + i * 1e-7, -100.0) for i in range(12)],
        "station_id string, latitude double, longitude double",
    )
    found = ip.assign_stations(cells, stations)
    if km in (50.0, 200.0):  # just at the limit the sphere's rounding decides; step a metre further
        found = ip.assign_stations(cells, stations.withColumn("latitude", F.col("latitude") + 1e-5))
    assert rows(found, "station_id") == [(f"S{i:02d}",) for i in range(tier)]
    assert {r.primary_station for r in found.collect()} == {"S00"}


def fire(line, fid, lat, lon, size, start="2023-07-01", out="2023-07-05", kind="Lightning"):
    return (fid, line, lat, lon, start, out, size, kind)


FIRE_SCHEMA = (
    "fire_id string, line_no long, latitude double, longitude double, rep_date string, out_date string, size_ha double, fire_type string"
)


@pytest.fixture(scope="module")
def cells(spark):
    points = [(i * 10 + j, 50.0 + i * 0.05, -115.0 + j * 0.05) for i in range(10) for j in range(10)]
    return spark.createDataFrame(points, "cell_id long, center_lat double, center_lon double")


def test_fires_on_cells(spark, cells):
    reports = spark.createDataFrame(
        [
            fire(1, "F1", 50.2, -114.8, 1_000_000.0),
            fire(2, "F1", 50.3, -114.7, 50_000.0),              # a later report of F1
            fire(3, "F2", 50.0, -115.0, None, out=None, kind=""),
            fire(4, "F3", 50.02, -115.02, 1.0),                  # reaches no cell centre
            fire(5, "F4", 50.2, -114.8, 5_000.0, out="not a day"),
            fire(6, "F5", 50.1, -114.9, 10_000.0, start="2023/08/01", out="0000/00/00"),
            fire(7, "F6", 59.0, -80.0, 1_000_000.0),             # outside the extent
        ],
        FIRE_SCHEMA,
    )
    for bound in (None, 100):
        burned = fires.burned_lines(reports, cells, bound)
        lines = {r.line_no: r for r in burned.collect()}
        assert set(lines) == {1, 2, 3, 6}
    everyone = {
        c.cell_id for c in cells.collect()
        if _km(50.2, -114.8, c.center_lat, c.center_lon) <= 20.0
    }
    assert lines[1].affected_cells == sorted(everyone) and lines[1].center_cell_id == 44
    assert lines[3].affected_cells == [0] and lines[3].size_ha == 1.0
    events = {r.fire_id: r for r in fires.fire_events(burned).collect()}
    assert set(events) == {"F1", "F2", "F5"} and events["F1"].total_size_ha == 1_000_000.0
    assert events["F2"].fire_type == "Unknown" and events["F2"].end_date == events["F2"].start_date
    assert str(events["F5"].start_date) == str(events["F5"].end_date) == "2023-08-01"
    relations = fires.cell_fires(burned)
    assert relations.count() == relations.select("cell_id", "fire_id").distinct().count()
    by_line = burned.select("line_no", "size_ha", F.size("affected_cells").alias("n")).filter("line_no = 1").first()
    share = relations.filter("fire_id = 'F1' AND cell_id = 44").first().fire_size_ha
    assert share * by_line.n == pytest.approx(by_line.size_ha)
    assert rows(fires.cells_with_history(relations, fires.fire_events(burned).filter("fire_id = 'F2'"))) == [(0,)]


def test_a_report_that_stands_in_two_files(spark, cells):
    one = spark.createDataFrame([fire(0, "F1", 50.2, -114.8, 1_000_000.0), fire(1, "F2", 50.3, -114.7, 50_000.0)], FIRE_SCHEMA)
    other = spark.createDataFrame([fire(0, "F1", 50.2, -114.8, 1_000_000.0), fire(1, "F2", 50.3, -114.7, 40_000.0)], FIRE_SCHEMA)
    in_file = lambda df, name: df.withColumn("source_file", F.lit(name))
    single = fires.burned_lines(in_file(one, "a.csv"), cells)
    both = fires.burned_lines(in_file(other, "b.csv").unionByName(in_file(one, "a.csv")), cells)
    assert both.count() == 4
    assert rows(fires.fire_events(both)) == rows(fires.fire_events(single))
    assert rows(fires.cell_fires(both)) == rows(fires.cell_fires(single))


def test_last_reading_wins_over_files(spark):
    made = spark.createDataFrame(
        [("S", "2023-01-01", "TMAX", 1.0, "C", 9, "a"), ("S", "2023-01-01", "TMAX", 2.0, "C", 1, "b")],
        "station_id string, date string, element string, value double, quality string, line_no long, source_file string",
    ).withColumn("date", F.col("date").cast("date"))
    assert weather.weather_wide(made).first().tmax == 2.0


def _km(lat1, lon1, lat2, lon2):
    p1, p2 = math.radians(lat1), math.radians(lat2)
    a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(a))


def test_fire_reach_is_complete_at_high_latitude(spark):
    points = [(i, 70.0 + (i // 40) * 0.04, 10.0 + (i % 40) * 0.05) for i in range(800)]
    far_cells = spark.createDataFrame(points, "cell_id long, center_lat double, center_lon double")
    reports = spark.createDataFrame([fire(1, "F", 70.41, 10.99, 1_000_000.0)], FIRE_SCHEMA)
    found = fires.burned_lines(reports, far_cells).first().affected_cells
    assert found == [i for i, lat, lon in points if _km(70.41, 10.99, lat, lon) <= 20.0]


def test_fire_days(spark):
    relations = spark.createDataFrame(
        [(1, "A", dt.date(2023, 7, 1), dt.date(2023, 7, 3)), (1, "B", dt.date(2023, 7, 1), dt.date(2023, 7, 3)),
         (1, "C", dt.date(2023, 7, 3), dt.date(9999, 12, 31)), (2, "D", dt.date(2023, 7, 5), dt.date(2023, 7, 4))],
        "cell_id long, fire_id string, fire_start_date date, fire_end_date date",
    )
    days = fires.fire_days(relations, "2023-07-02", "2023-07-04")
    assert rows(days.selectExpr("cell_id", "day(date)", "n_fires")) == [(1, 2, 2), (1, 3, 3), (1, 4, 1)]
    keys = spark.createDataFrame([(1, dt.date(2023, 7, 4)), (2, dt.date(2023, 7, 4))], "cell_id long, date date")
    assert rows(fires.fire_status(keys, days), "cell_id", "fire_occurred") == [(1, 1), (2, 0)]


def test_fire_status_in_spans_equals_days(spark):
    rng = random.Random(12)
    date, day = dt.date, dt.timedelta(1)
    first = date(2022, 12, 1)
    intervals = [(0, date(2023, 1, 10), date(2023, 1, 5)), (3, date(2020, 5, 1), date(2025, 6, 1))]
    for _ in range(400):
        begins = first + day * rng.randint(0, 200)
        intervals.append((rng.choice([0, 0, 0, 1, 2]), begins, begins + day * (rng.choice([0, 1, 3, 40]) if rng.random() < 0.3 else 0)))
    burning = spark.createDataFrame(intervals, "cell_id long, fire_start_date date, fire_end_date date")
    keys = spark.range(6).withColumnRenamed("id", "cell_id").selectExpr("cell_id", "explode(sequence(DATE'2022-11-20', DATE'2023-07-30')) AS date")
    for asked in (burning, burning.filter("cell_id = 2").limit(3)):
        days = fires.fire_days(asked, "2022-01-01", "2024-12-31")
        assert rows(fires.fire_status_in_spans(keys, asked)) == rows(fires.fire_status(keys, days))
        spans = fires.burning_spans(asked)
        assert spans.filter("first_day > last_day OR year(first_day) <> year OR year(last_day) <> year").isEmpty()
    endless = spark.createDataFrame([(1, None, date(2023, 1, 1)), (1, date(2023, 1, 1), None)], burning.schema)
    assert fires.fire_status_in_spans(keys, endless).filter("fire_occurred = 1").isEmpty()
