import json
import random

import pytest
from pyspark.sql import functions as F

from emberline import config as C
from emberline.operators import geo
from emberline.plans import pipeline
from emberline.sources.station_text import read_lines

BOUNDS = C.REGIONS["vancouver"]


def write_raw(folder):
    """Twelve stations in one region, three years of daily lines, fires of which one file is broken."""
    rng = random.Random(1)
    (folder / "daily").mkdir()
    (folder / "fires").mkdir()
    stations, inventory = [], []
    # Twelve Canadian stations, and one inside the box that is not: neither it nor its readings may appear, but its inventory
    # line does, as the inventory is kept by the box alone.
    for i in range(13):
        sid = f"CA{i:09d}" if i < 12 else "US000000099"
        lat, lon = 49.0 + rng.random(), -125.0 + 3 * rng.random()
        stations.append(f"{sid:<11} {lat:8.4f} {lon:9.4f} {100.0 + i:6.1f}    {'STATION ' + str(i):<30} GSN     71{i:03d}")
        inventory.append(f"{sid:<11} {lat:8.4f} {lon:9.4f} TMAX 1990 2024")
        lines = []
        for year in (2021, 2022, 2023, 2024):
            for month in range(1, 13):
                for element, low, high in (("TMAX", 0, 300), ("TMIN", -200, 0), ("TAVG", -50, 150), ("PRCP", 0, 50), ("SNWD", 0, 300)):
                    days = "".join(f"{rng.randint(low, high):5d}  C" for _ in range(31))
                    lines.append(f"{sid}{year}{month:02d}{element}{days}")
        (folder / "daily" / f"{sid}.dly").write_text("\n".join(lines) + "\n")
    (folder / "stations.txt").write_text("\n".join(stations) + "\n")
    (folder / "inventory.txt").write_text("\n".join(inventory) + "\n")
    head = "NFDBFIREID,LATITUDE,LONGITUDE,YEAR,MONTH,DAY,REP_DATE,OUT_DATE,SIZE_HA,FIRE_TYPE,geometry_wkt\n"
    fires = [
        f"F{i},{49 + rng.random():.4f},{-125 + 3 * rng.random():.4f},{2022 + i % 3},7,{1 + i % 28},{2022 + i % 3}/07/{1 + i % 28:02d},"
        f"{2022 + i % 3}/08/{1 + i % 28:02d},{rng.choice([500, 50000, 400000])},Fire,"
        for i in range(40)
    ]
    (folder / "fires" / "points.csv").write_text(head + "\n".join(fires) + "\nBAD,49.5,-124,2023,7,40,2023/07/01,,1,Fire,\nOUT,10,10,2023,7,1,2023/07/01,,1,Fire,\n")
    (folder / "fires" / "shapes.csv").write_text("NFDBFIREID,YEAR,MONTH,DAY,SIZE_HA\nX,2023,7,1,5\n")
    return pipeline.RawInputs(
        str(folder / "stations.txt"), str(folder / "daily"), str(folder / "inventory.txt"), str(folder / "fires")
    )


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    folder, out = tmp_path_factory.mktemp("raw"), str(tmp_path_factory.mktemp("out"))
    raw = write_raw(folder)
    ws = pipeline.run(spark, raw, out, km=20.0, bounds=BOUNDS, confidence_min={t: 0.1 for t in C.CONFIDENCE_MIN})
    return raw, out, ws


def test_tables(spark, built):
    raw, out, ws = built
    read = lambda name: pipeline.stored(spark, out, name)
    assert read("stations").count() == 12
    wide = read("weather_wide")
    assert wide.filter("station_id LIKE 'US%'").count() == 0
    assert wide.count() == 12 * 1096 == wide.select("station_id", "date").distinct().count()
    assert wide.filter("data_completeness = 1.0").count() == wide.count()
    pairs = geo.pairs_within(read("stations"))
    assert pairs.count() == 12 * 11 and read("station_neighbors").count() == 12 * 10
    assert pairs.alias("a").join(
        pairs.alias("b"),
        F.expr("a.station_1 = b.station_2 AND a.station_2 = b.station_1 AND a.distance_km = b.distance_km"),
    ).count() == 132
    land = read("grid_cells").filter("terrain_type <> 'water'").count()
    data = read("weather_data")
    assert data.count() == land * 1096 == data.select("cell_id", "date").distinct().count()
    assert data.filter("confidence_score NOT BETWEEN 0.1 AND 1").count() == 0
    events, relations = read("fire_events"), read("cell_fire")
    assert events.count() == events.select("fire_id").distinct().count() > 0
    sums = relations.groupBy("fire_id").agg(F.sum("fire_size_ha").alias("s")).join(events, "fire_id")
    assert sums.filter("abs(s - total_size_ha) > 1e-6").count() == 0
    assert json.loads(events.first().affected_cells)
    counts = {r.key: r.value for r in read("metadata").collect()}
    assert counts["weather_records_count"] == str(12 * 1096)


def test_reports(spark, built):
    _, out, _ = built
    read = lambda name: spark.read.option("header", True).csv(f"{out}/validated/{name}")
    counts = {r.table_name: (r.processed, r.valid, r.removed) for r in read("report_counts").collect()}
    assert counts == {"stations": ("12", "12", "0"), "station_inventory": ("13", "13", "0"), "wildfires": ("41", "40", "1")}
    assert [r.detail for r in read("report_rejects").collect()] == ["BAD"]
    assert read("skipped_files").first().source_file.endswith("shapes.csv")


def test_samples(spark, built):
    _, out, ws = built
    train = spark.read.option("header", True).csv(f"{out}/samples/train")
    assert tuple(train.columns) == C.SAMPLE_COLUMNS and train.count() > 0
    meta = json.loads(spark.read.text(f"{out}/samples/metadata").first().value)
    assert meta["training_samples"] == train.count()
    assert sum(meta["terrain_distribution"].values()) == train.count()
    assert set(meta["fire_distribution"]) == {"0", "1"}


def test_collect_daily(spark, built, tmp_path):
    raw, _, _ = built
    unknown = pipeline.collect_daily(spark, raw, str(tmp_path / "kept"), 2022, 2023)
    assert unknown.count() == 0
    assert spark.read.text(str(tmp_path / "kept")).count() == 12 * 24 * 5
    assert read_lines(spark, raw.daily).count() == 13 * 48 * 5
