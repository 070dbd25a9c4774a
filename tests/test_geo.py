import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from emberline import config as C
from emberline.functions import exprs as X
from emberline.operators import geo, grid


def cloud(spark, n, seed, hot=0.34, dense=0.2):
    """Points of which a third lie at one spot and a fifth within a few metres."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        u = rng.random()
        if u < hot:
            place = (50.0, -100.0)
        elif u < hot + dense:
            place = (50.5 + rng.random() * 1e-4, -100.5 + rng.random() * 1e-4)
        else:
            place = (rng.uniform(-60, 60), rng.uniform(-170, 170))
        out.append((i, *place))
    return out, spark.createDataFrame(out, "id long, lat double, lon double")


def brute(queries, points, k, distance, skip_self):
    found = set()
    for q in queries:
        ranked = sorted(
            (round(distance(q, p), 9), p[0]) for p in points if not (skip_self and p[0] == q[0])
        )[:k]
        found |= {(q[0], p, r + 1) for r, (_, p) in enumerate(ranked)}
    return found


EUCLID = lambda a, b: math.sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2)
MANHATTAN = lambda a, b: abs(a[1] - b[1]) + abs(a[2] - b[2])


@pytest.mark.parametrize("metric, distance", [("euclid", EUCLID), ("manhattan", MANHATTAN)])
def test_nearest_k_equals_brute_force(spark, metric, distance):
    points, points_df = cloud(spark, 300, 1)
    found = geo.nearest_k(points_df, points_df, 7, metric, skip_self=True)
    assert {(r.query_id, r.point_id, r.rank) for r in found.collect()} == brute(points, points, 7, distance, True)
    asked, asked_df = cloud(spark, 60, 2, hot=0.1)
    found = geo.nearest_k(asked_df, points_df, 5, metric)
    assert {(r.query_id, r.point_id, r.rank) for r in found.collect()} == brute(asked, points, 5, distance, False)


@pytest.mark.parametrize("metric, distance", [("euclid", EUCLID), ("manhattan", MANHATTAN)])
def test_nearest_k_beside_a_cluster(spark, metric, distance):
    """Different positions crowded beside the queries: bins are cut, over several rounds, and the answer is that of brute force."""
    rng = random.Random(9)
    points = [(i, rng.uniform(50, 50.02), rng.uniform(-113, -112.98)) for i in range(1200)]
    points += [(2000 + i, rng.uniform(45, 55), rng.uniform(-120, -105)) for i in range(60)]
    asked = [(i, rng.uniform(49.5, 50.5), rng.uniform(-114, -112)) for i in range(40)] + [(90, 50.01, -112.99), (91, -40.0, 100.0)]
    frames = [spark.createDataFrame(rows, "id long, lat double, lon double") for rows in (asked, points)]
    expected = brute(asked, points, 6, distance, False)
    for unit, fan in ((256, 256), (8, 4), (1, 2)):
        found = geo.nearest_k(*frames, 6, metric, query_bound=100, unit=unit, fan=fan).collect()
        assert {(r.query_id, r.point_id, r.rank) for r in found} == expected


def test_no_bin_of_a_cluster_meets_a_query_whole(spark):
    rng = random.Random(10)
    points = spark.createDataFrame([(i, rng.uniform(50, 50.02), rng.uniform(-113, -112.98)) for i in range(3000)], "id long, lat double, lon double")
    nodes = points.selectExpr("CAST(floor(lat * 16384) AS LONG) iy", "CAST(floor(lon * 16384) AS LONG) ix", "explode(sequence(0, 23)) lvl").selectExpr(
        "lvl", "shiftright(iy, lvl) by", "shiftright(ix, lvl) bx").groupBy("lvl", "by", "bx").count().withColumnRenamed("count", "n")
    root = nodes.filter("lvl = 16 AND n > 100").select("lvl", "by", "bx", "n")
    parts = geo._cut_up(root, nodes, 100, 256).collect()
    assert sum(r.n for r in parts) == root.agg(F.sum("n")).first()[0] and max(r.n for r in parts) <= 100


@pytest.mark.parametrize("km, region", [(100.0, None), (50.0, None), (10.0, "vancouver"), (500.0, "toronto")])
def test_lattice_neighbors_equal_the_search(spark, km, region):
    bounds = C.REGIONS[region] if region else C.SOUTHERN_CANADA
    cells = grid.grid_cells(spark, km, bounds)
    ends = cells.filter("cell_id % 13 = 1 OR terrain_type = 'urban'") if grid.count_cells(km, bounds) > 500 else cells
    expected = geo.cell_neighbors(ends, cells)
    names = ["cell_id", "neighbor_id", "degrees", "rank"]
    assert rows(grid.lattice_neighbors(ends, km, bounds), *names) == rows(expected, *names)
    plan = grid.lattice_neighbors(ends, km, bounds)._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    assert "Exchange" not in plan


def test_nearest_k_with_too_few_points(spark):
    points, points_df = cloud(spark, 4, 3)
    found = geo.nearest_k(points_df, points_df, 10, "euclid", skip_self=True)
    assert found.count() == 12


def test_pairs_equal_brute_force_also_when_bins_are_split(spark):
    points, df = cloud(spark, 200, 4)
    stations = df.select(F.col("id").cast("string").alias("station_id"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
    expected = {
        (str(a[0]), str(b[0])) for a in points for b in points if a[0] != b[0] and EUCLID(a, b) * C.KM_PER_DEGREE < 500
    }
    found = [(r.station_1, r.station_2) for r in geo.pairs_within(stations).collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    reach = 500 / C.KM_PER_DEGREE
    split = geo.bin_join(df, df, F.lit(reach), F.lit(reach), reach, reach, split_rows=10).filter(
        X.euclid_degrees(F.col("l.lat"), F.col("l.lon"), F.col("r.lat"), F.col("r.lon")) * C.KM_PER_DEGREE < 500
    )
    found = [(str(r.a), str(r.b)) for r in split.filter("l.id <> r.id").selectExpr("l.id AS a", "r.id AS b").collect()]
    assert len(found) == len(set(found)) and set(found) == expected


def test_station_neighbors_are_the_first_of_the_pairs(spark):
    _, df = cloud(spark, 150, 5)
    stations = df.select(F.col("id").cast("string").alias("station_id"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
    from_pairs = geo.pairs_within(stations).selectExpr(
        "station_1", "station_2",
        "row_number() OVER (PARTITION BY station_1 ORDER BY round(distance_km / 111.32, 9), station_2) AS n",
    ).filter("n <= 10")
    assert rows(geo.station_neighbors(stations), "station_id", "neighbor_id", "rank") == rows(from_pairs)


def test_distances(spark):
    one = spark.range(1)
    values = one.select(
        X.haversine_km(F.lit(50.0), F.lit(-115.0), F.lit(50.5), F.lit(-115.0)),
        X.haversine_km(F.lit(50.0), F.lit(-115.0), F.lit(50.0), F.lit(-114.5)),
        X.fire_radius_km(F.lit(100.0)), X.fire_radius_km(F.lit(10_000.0)), X.fire_radius_km(F.lit(1_000_000.0)),
    ).first()
    assert [round(v, 6) for v in values] == [55.597463, 35.737294, 0.564190, 5.641896, 20.0]


BOX = C.SOUTHERN_CANADA
SHAPES = {
    "inside": ("POLYGON ((-115 50, -114 50, -114 51, -115 50))", True),
    "edge crosses, no vertex inside": ("POLYGON ((-150 50, -40 50.5, -40 51, -150 50))", True),
    "contains the box": ("POLYGON ((-170 30, -20 30, -20 80, -170 80, -170 30))", True),
    "box in the hole": (
        "POLYGON ((-170 30, -20 30, -20 80, -170 80, -170 30), (-160 35, -30 35, -30 75, -160 75, -160 35))", False,
    ),
    "envelope only": ("POLYGON ((-140 58, -140 65, -133 65, -140 58))", False),
    "disjoint": ("POLYGON ((0 0, 1 0, 1 1, 0 0))", False),
    "second part inside": ("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((-115 50, -114 50, -114 51, -115 50)))", True),
    "touches the corner": ("POLYGON ((-52.67 60, -50 60, -50 62, -52.67 60))", True),
    "empty": ("POLYGON EMPTY", False),
}


def test_polygon_meets_box(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in SHAPES.items()], "name string, wkt string")
    found = {r.name: r.m for r in df.select("name", geo.polygon_meets_box("wkt").alias("m")).collect()}
    assert found == {k: v[1] for k, v in SHAPES.items()}


GOLDEN = [
    (None, 50.0, {"land": 738, "forest": 2297, "urban": 16, "water": 1865}, 10),
    (None, 100.0, {"land": 185, "forest": 592, "urban": 5, "water": 482}, 3),
    ("toronto", 10.0, {"urban": 156, "water": 48}, 156),
    ("vancouver", 10.0, {"forest": 204, "urban": 48, "water": 12}, 0),
    ("calgary", 10.0, {"forest": 180}, 0),
    ("montreal", 10.0, {"forest": 80, "urban": 16}, 0),
]


@pytest.mark.parametrize("region, km, terrain, wet_urban", GOLDEN)
def test_grid_counts(spark, region, km, terrain, wet_urban):
    bounds = C.REGIONS[region] if region else C.SOUTHERN_CANADA
    cells = grid.grid_cells(spark, km, bounds).collect()
    assert sorted(c.cell_id for c in cells) == list(range(1, sum(terrain.values()) + 1))
    assert grid.count_cells(km, bounds) == len(cells)
    counts = {}
    for c in cells:
        counts[c.terrain_type] = counts.get(c.terrain_type, 0) + 1
    assert counts == terrain
    assert sum(c.is_water for c in cells if c.urban_flag) == wet_urban


def test_full_grid_counts(spark):
    cells = grid.grid_cells(spark, 10.0)
    assert {r.terrain_type: r["count"] for r in cells.groupBy("terrain_type").count().collect()} == {
        "land": 16_999, "forest": 57_545, "urban": 312, "water": 46_628,
    }
    assert grid.land_total(cells).first().n_cells == 16_999 + 57_545 + 312


def test_regions_agree_with_single_grids(spark):
    many = grid.with_terrain(grid.grid_of_regions(grid.region_table(spark, C.REGIONS), 10.0))
    for name, bounds in C.REGIONS.items():
        one = grid.grid_cells(spark, 10.0, bounds).selectExpr("cell_id", "round(center_lat, 9) a", "round(center_lon, 9) b", "terrain_type")
        part = many.filter(F.col("region_id") == name).selectExpr(
            "cell_id", "round(center_lat, 9) a", "round(center_lon, 9) b", "terrain_type"
        )
        assert rows(one) == rows(part)


def test_pairs_of_few_bytes_are_spread_over_tasks(spark):
    _, df = cloud(spark, 400, 9, hot=0.0, dense=0.0)
    stations = df.select(F.col("id").cast("string").alias("station_id"), (F.col("lat") / 10).alias("latitude"), (F.col("lon") / 10).alias("longitude"))
    pairs = geo.pairs_within(stations.coalesce(1))
    assert pairs.select(F.spark_partition_id().alias("task")).distinct().count() > 1
