"""Curvature-adjusted grids and their terrain."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from emberline import config as C
from emberline.functions import exprs as X


def region_table(spark: SparkSession, regions: dict[str, C.Bounds]) -> DataFrame:
    rows = [(name, b.lat_min, b.lat_max, b.lon_min, b.lon_max) for name, b in regions.items()]
    return spark.createDataFrame(
        rows, "region_id string, lat_min double, lat_max double, lon_min double, lon_max double"
    )


def grid_of_regions(regions: DataFrame, km: float) -> DataFrame:
    """Grid cells of every region: (region_id, cell_id, center_lat, center_lon).

    Rows are ``km`` apart; within a row the longitude step widens with latitude. Both ranges are half open. Cell ids run
    from 1 through the rows of their region. The running count that gives the ids is over rows only, of which a
    region has at most 180 * 111.32 / km; the cells themselves are never sorted or numbered by a window.
    """
    step = F.lit(km / C.KM_PER_DEGREE)
    n_rows = F.ceil((F.col("lat_max") - F.col("lat_min")) / step)
    rows = (
        regions.filter((F.col("lat_min") < F.col("lat_max")) & (F.col("lon_min") < F.col("lon_max")))
        .withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), n_rows - 1)))
        .withColumn("center_lat", F.col("lat_min") + F.col("row") * step)
        .withColumn("lon_step", F.lit(km) / (F.lit(C.KM_PER_DEGREE) * F.cos(F.radians("center_lat"))))
        .withColumn("n_lon", F.ceil((F.col("lon_max") - F.col("lon_min")) / F.col("lon_step")))
    )
    before = Window.partitionBy("region_id").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("first_id", F.coalesce(F.sum("n_lon").over(before), F.lit(0)))
    # Few rows make many cells: spread the rows over all cores before the cells are generated.
    spread = numbered.repartition(regions.sparkSession.sparkContext.defaultParallelism, "region_id", "row")
    return spread.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_lon") - 1))).select(
        "region_id",
        (F.col("first_id") + F.col("j") + 1).alias("cell_id"),
        "center_lat",
        (F.col("lon_min") + F.col("j") * F.col("lon_step")).alias("center_lon"),
    )


def with_terrain(cells: DataFrame) -> DataFrame:
    lat, lon = "center_lat", "center_lon"
    return cells.withColumns(
        {
            "terrain_type": X.terrain_type(lat, lon),
            "is_water": X.in_water(lat, lon).cast("int"),
            "urban_flag": X.in_urban(lat, lon).cast("int"),
        }
    )


def grid_rows(km: float, bounds: C.Bounds) -> list[tuple[float, float, int, int]]:
    """Latitude, longitude step, cell count and cells before, for each row of a box: arithmetic on the parameters, with at
    most 180 * 111.32 / km rows."""
    step = km / C.KM_PER_DEGREE
    rows, before = [], 0
    for i in range(math.ceil((bounds.lat_max - bounds.lat_min) / step)):
        lat = bounds.lat_min + i * step
        lon_step = km / (C.KM_PER_DEGREE * math.cos(math.radians(lat)))
        n = math.ceil((bounds.lon_max - bounds.lon_min) / lon_step)
        rows.append((lat, lon_step, n, before))
        before += n
    return rows


def grid_cells(spark: SparkSession, km: float = 10.0, bounds: C.Bounds = C.SOUTHERN_CANADA) -> DataFrame:
    """The classified grid of one box, generated without any shuffle: every row knows how many cells come before it."""
    rows = grid_rows(km, bounds)
    names = ("center_lat", "lon_step", "n_lon", "before")
    table = pa.table({name: [row[i] for row in rows] for i, name in enumerate(names)})
    cells = (
        spark.createDataFrame(table)
        .withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_lon") - 1)))
        .select(
            (F.col("before") + F.col("j") + 1).alias("cell_id"),
            "center_lat",
            (F.lit(bounds.lon_min) + F.col("j") * F.col("lon_step")).alias("center_lon"),
        )
    )
    return with_terrain(cells)


def lattice_neighbors(
    targets: DataFrame, km: float = 10.0, bounds: C.Bounds = C.SOUTHERN_CANADA, k: int = C.CELL_NEIGHBORS
) -> DataFrame:
    """The k nearest cells of each target cell of a box's grid by summed degree differences, over all terrains: (cell_id, neighbor_id,
    degrees, rank). Ties (nine decimals) go to the lower id; a target outside the grid has the nearest cells all the same, as far as its
    row reaches.

    The lattice itself names the candidates, so nothing is searched, joined or shuffled, however many targets there are: in each row the k cells
    on either side of the target's longitude, and of rows those up to k and a few beyond. Every row in between has a cell that is at most a
    longitude step off, which is less than the rows beyond k are further away.
    """
    table = grid_rows(km, bounds)
    if not table:
        return targets.select("cell_id", F.lit(0).cast("long").alias("neighbor_id"), F.lit(0.0).alias("degrees"), F.lit(0).alias("rank")).limit(0)
    step = km / C.KM_PER_DEGREE
    reach = k + math.ceil(max(lon_step for _, lon_step, _, _ in table) / step)
    # One row: at most 180 * 111.32 / km entries.
    lattice = (
        targets.sparkSession.createDataFrame(table, "lat double, lon_step double, n long, before long")
        .agg(F.array_sort(F.collect_list(F.struct("lat", "lon_step", "n", "before"))).alias("rows"))
        .scalar()
    )
    own = F.round((F.col("center_lat") - F.lit(bounds.lat_min)) / F.lit(step)).cast("int")

    def in_row(i):
        row = F.get(F.col("_rows"), i)
        at = F.floor((F.col("center_lon") - F.lit(bounds.lon_min)) / row["lon_step"])
        low = F.greatest(F.lit(0).cast("long"), F.least(at, row["n"]) - (k - 1))
        high = F.least(row["n"] - 1, F.greatest(at, F.lit(-1).cast("long")) + k)
        return F.transform(
            F.sequence(F.least(low, high), high),
            lambda j: F.struct(
                F.round(
                    X.manhattan_degrees(F.col("center_lat"), F.col("center_lon"), row["lat"], F.lit(bounds.lon_min) + j * row["lon_step"]), 9
                ).alias("degrees"),
                (row["before"] + j + 1).alias("neighbor_id"),
            ),
        )

    first, last = F.greatest(own - reach, F.lit(0)), F.least(own + reach, F.lit(len(table) - 1))
    rows = F.filter(F.sequence(F.least(own - reach, F.lit(len(table) - 1)), F.greatest(own + reach, F.lit(0))), lambda i: i.between(first, last))
    others = F.filter(F.flatten(F.transform(rows, in_row)), lambda c: c["neighbor_id"] != F.col("cell_id"))
    return targets.select("cell_id", "center_lat", "center_lon", lattice.alias("_rows")).select(
        "cell_id", F.posexplode(F.slice(F.array_sort(others), 1, k)).alias("pos", "c")
    ).select("cell_id", "c.neighbor_id", "c.degrees", (F.col("pos") + 1).alias("rank"))


def count_cells(km: float, bounds: C.Bounds = C.SOUTHERN_CANADA) -> int:
    """Number of cells of a grid, from its parameters alone; used to decide whether a cell table may be broadcast."""
    return sum(row[2] for row in grid_rows(km, bounds))


def land_cells(cells: DataFrame) -> DataFrame:
    return cells.filter(F.col("terrain_type").isin(*C.LAND_TERRAINS))


def land_total(cells: DataFrame) -> DataFrame:
    return land_cells(cells).agg(F.count("*").alias("n_cells"))
