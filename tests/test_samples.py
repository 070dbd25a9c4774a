import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from emberline import config as C
from emberline.operators import features, fires, profile, sampling


def stats_table(spark, n=3000):
    """Plenty of cells of every terrain; forest holds most of them."""
    out = []
    for i in range(n):
        terrain = ("forest", "forest", "forest", "land", "urban", "water")[i % 6]
        burned = 0 if terrain == "water" else int(i % 5 in (0, 1))
        out.append((i, terrain, 0.9, 400 if terrain != "water" else 0, burned))
    return spark.createDataFrame(
        out, "cell_id long, terrain_type string, avg_confidence double, data_days long, fire_count long"
    )


def test_quotas(spark):
    chosen = sampling.target_cells(stats_table(spark))
    counts = {r.terrain_type: (r.n, r.f) for r in chosen.groupBy("terrain_type").agg(
        F.count("*").alias("n"), F.sum((F.col("fire_count") > 0).cast("int")).alias("f")).collect()}
    # 200 + 125 + 100 cells and the first 50 water cells: 475 of the 500 asked for.
    assert counts == {"forest": (200, 100), "land": (125, 62), "urban": (100, 50), "water": (50, 0)}
    water = sorted(r.cell_id for r in chosen.filter("terrain_type = 'water'").collect())
    assert water == [5 + 6 * i for i in range(50)]


def test_thresholds_and_shortage(spark):
    few = stats_table(spark, 120).withColumn(
        "avg_confidence", F.when(F.col("terrain_type") == "urban", 0.69).otherwise(F.lit(0.4))
    )
    chosen = sampling.target_cells(few)
    counts = {r.terrain_type: r["count"] for r in chosen.groupBy("terrain_type").count().collect()}
    assert counts == {"forest": 60, "land": 20, "water": 20}
    assert sampling.target_cells(few.withColumn("data_days", F.lit(99).cast("long"))).filter("terrain_type <> 'water'").count() == 0


def test_pool_cells(spark):
    pool = sampling.pool_cells(stats_table(spark).withColumn("data_days", F.lit(60).cast("long")), size=1000)
    counts = {r.terrain_type: r["count"] for r in pool.groupBy("terrain_type").count().collect()}
    assert counts == {"forest": 400, "urban": 150, "water": 200}


@pytest.fixture(scope="module")
def small(spark):
    """Three land cells with daily weather over four years, a water cell, and overlapping fires."""
    rng = random.Random(7)
    day0, data = dt.date(2020, 1, 1), []
    for cell in (1, 2, 3):
        for i in range(1827):
            gone = rng.random() < 0.1
            data.append((cell, day0 + dt.timedelta(days=i), None if gone else rng.uniform(-20, 30),
                         None if rng.random() < 0.1 else rng.uniform(-20, 30), None if rng.random() < 0.1 else rng.uniform(0, 3)))
    relations = [
        (1, "A", dt.date(2023, 7, 1), dt.date(2023, 7, 20)), (1, "B", dt.date(2023, 7, 10), dt.date(2023, 7, 25)),
        (2, "C", dt.date(2022, 5, 1), dt.date(2022, 5, 1)), (1, "D", dt.date(2022, 7, 1), dt.date(2022, 7, 4)),
    ]
    cells = [(1, "forest", 0, 0), (2, "land", 0, 0), (3, "urban", 0, 1), (9, "water", 1, 0)]
    neighbors = [(1, 2), (1, 3), (1, 9), (2, 1), (3, 9)]
    weather = spark.createDataFrame(data, "cell_id long, date date, tmax double, tavg double, prcp double")
    cell_fire = spark.createDataFrame(relations, "cell_id long, fire_id string, fire_start_date date, fire_end_date date")
    return {
        "data": data, "relations": relations, "weather": weather.persist(), "cell_fire": cell_fire,
        "cells": spark.createDataFrame(cells, "cell_id long, terrain_type string, is_water int, urban_flag int"),
        "neighbors": spark.createDataFrame(neighbors, "cell_id long, neighbor_id long"), "pairs": neighbors,
        "days": fires.fire_days(cell_fire, "2019-01-01", "2025-12-31"),
    }


def targets_table(spark):
    return spark.createDataFrame(
        [(1, "forest", 3), (2, "land", 1), (3, "urban", 0), (9, "water", 0)], "cell_id long, terrain_type string, fire_count long"
    )


def test_sample_dates(spark, small):
    for kind, n in (("train", 10), ("test", 20)):
        drawn = sampling.sample_dates(targets_table(spark), small["weather"], small["cell_fire"], kind).collect()
        by_cell = {}
        for r in drawn:
            by_cell.setdefault(r.cell_id, []).append((r.draw, r.target_date))
        assert {c: len(v) for c, v in by_cell.items()} == {1: n, 2: n, 3: n, 9: n}
        assert all(sorted(d for d, _ in v) == list(range(1, n + 1)) for v in by_cell.values())
        # Cell 1: the first burning days in order of interval; cell 2 has a single one.
        first = [d for _, d in sorted(by_cell[1])][: n // 2]
        order = [dt.date(2022, 7, 1) + dt.timedelta(days=i) for i in range(4)]
        order += [dt.date(2023, 7, 1) + dt.timedelta(days=i) for i in range(20)]
        assert first == order[: n // 2]
        assert sorted(by_cell[2])[0][1] == dt.date(2022, 5, 1)
        assert all(dt.date(2022, 1, 1) <= d <= dt.date(2024, 12, 31) for c in (1, 2, 3) for _, d in by_cell[c])
        lo, hi = (dt.date.fromisoformat(x) for x in C.WATER_DATES[kind])
        assert all(lo <= d <= hi for _, d in by_cell[9])
    split = sampling.sample_dates(targets_table(spark), small["weather"], small["cell_fire"], "test", temporal_split=True)
    assert {r.target_date.year for r in split.filter("terrain_type <> 'water'").collect()} == {2024}


def expected_year(small, cell, day, back):
    mid = day.replace(year=day.year - back)
    found = []
    for c, d, tmax, tavg, prcp in small["data"]:
        if c == cell and abs((d - mid).days) <= 7:
            hits = [f for f in small["relations"] if f[0] == c and f[2] <= d <= f[3]]
            found += [(tmax, tavg, prcp, int(bool(hits)))] * max(1, len(hits))
    return found


def mean(values):
    kept = [v for v in values if v is not None]
    return sum(kept) / len(kept) if kept else None


def test_features_equal_brute_force(spark, small):
    keys = [(1, dt.date(2024, 7, 12)), (2, dt.date(2023, 5, 3)), (3, dt.date(2022, 12, 30)), (3, dt.date(2021, 1, 3))]
    df = spark.createDataFrame(keys, "cell_id long, target_date date")
    yearly = {(r.cell_id, r.target_date): r for r in features.yearly_features(df, small["weather"], small["days"]).collect()}
    near = {(r.cell_id, r.target_date): r for r in features.neighbor_features(
        df, small["neighbors"], small["weather"], small["days"]).collect()}
    for cell, day in keys:
        got = yearly[cell, day]
        means = []
        for back in (1, 2, 3):
            rows_ = expected_year(small, cell, day, back)
            means.append(mean([r[1] for r in rows_]) if rows_ else 0.0)
            assert got[f"year_{back}_avg_temp"] == pytest.approx(means[-1])
            assert got[f"year_{back}_max_temp"] == pytest.approx(max((r[0] for r in rows_ if r[0] is not None), default=0.0))
            assert got[f"year_{back}_total_precip"] == pytest.approx(sum(r[2] for r in rows_ if r[2] is not None))
            assert got[f"year_{back}_dry_days"] == sum(r[2] is not None and r[2] < 1 for r in rows_)
            assert got[f"year_{back}_fire_occurred"] == max((r[3] for r in rows_), default=0)
        assert got.avg_temp_trend == pytest.approx((means[2] - means[0]) / 2)
        around = []
        for c, other in small["pairs"]:
            if c == cell:
                for k, d, tmax, _, prcp in small["data"]:
                    if k == other and d == day:
                        hits = [f for f in small["relations"] if f[0] == k and f[2] <= d <= f[3]]
                        around += [(tmax, prcp, int(bool(hits)))] * max(1, len(hits))
        got = near[cell, day]
        assert got.neighbor_terrain_types == (1.0 if around else 0.0)
        assert got.neighbor_avg_temp == (pytest.approx(mean([r[0] for r in around])) if around else 0.0)
        assert got.neighbor_total_precip == pytest.approx(sum(r[1] for r in around if r[1] is not None))
        assert got.neighbor_dry_days == sum(r[1] is not None and r[1] < 1 for r in around)
    # A day under two fires counts twice unless told otherwise.
    once = features.yearly_features(df, small["weather"], small["days"], dedupe_fires=True).filter("cell_id = 1").first()
    assert once.year_1_dry_days < yearly[keys[0]].year_1_dry_days


def test_training_samples(spark, small):
    samples = spark.createDataFrame(
        [(1, "forest", dt.date(2024, 2, 29), 1), (1, "forest", dt.date(2023, 7, 12), 2), (1, "forest", dt.date(2023, 7, 12), 3),
         (2, "land", dt.date(2023, 7, 12), 1), (2, "land", dt.date(2025, 7, 12), 2), (9, "water", dt.date(2024, 7, 1), 1)],
        "cell_id long, terrain_type string, target_date date, draw int",
    )
    out = features.training_samples(
        samples, small["cells"], small["weather"], small["cell_fire"], small["days"], small["neighbors"]
    )
    assert tuple(out.columns) == C.SAMPLE_COLUMNS and len(out.columns) == 36
    # No leap day, no day without weather; a day drawn twice stays twice.
    assert rows(out, "cell_id", "fire_occurred") == [(1, 1), (1, 1), (2, 0), (9, 0)]
    water, land = out.filter("cell_id = 9").first(), out.filter("cell_id = 1").first()
    assert (water.is_water, water.distance_to_urban_km, water.elevation_m, water.avg_temp_trend) == (1.0, 50.0, 0.0, None)
    assert water.neighbor_dry_days is None and water.terrain_type_encoded is None
    assert (land.is_water, land.terrain_type_encoded, land.historical_fire_frequency) == (None, 1.0, 1.0)
    meta = profile.dataset_metadata(out, out).first().metadata
    assert '"training_samples":4' in meta and '"terrain_distribution":{"forest":2,"land":1,"water":1}' in meta


def test_split_is_exact_and_stratified(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    marked = sampling.stratified_split(df, "y", 0.2, "id")
    counts = {r.y: (r.n, r.t) for r in marked.groupBy("y").agg(F.count("*").alias("n"), F.sum("is_test").alias("t")).collect()}
    assert counts == {0: (4500, 900), 1: (500, 100)}
    again = sampling.stratified_split(df.repartition(7), "y", 0.2, "id")
    assert rows(marked.filter("is_test = 1"), "id") == rows(again.filter("is_test = 1"), "id")


def test_random_subset(spark):
    df = spark.range(1000)
    a, b = (rows(sampling.random_subset(df, 200, "id", seed=s)) for s in (0, 1))
    assert len(a) == len(b) == 200 and a != b
    assert sampling.random_subset(df, 5000, "id").count() == 1000
