"""Station assignment and daily weather of grid cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from emberline import config as C
from emberline.functions import exprs as X
from emberline.operators.geo import nearest_k

MIXED_MEASURES = ("tmax", "tmin", "tavg", "temp_range", "prcp", "snwd", "data_completeness")
WEATHER_COLUMNS = (
    "cell_id", "date", "tmax", "tmin", "tavg", "temp_range", "prcp", "snwd", "year", "month", "day_of_year", "season",
    "data_completeness", "interpolation_method", "nearest_station_id", "nearest_station_distance_km",
    "station_count_used", "confidence_score",
)

# A cell uses at most five stations, about 64 bytes each in a hash table; cells are known from the grid's parameters.
STATIONS_PER_CELL = 5
ASSIGNMENT_BYTES = 64
BROADCAST_BYTES = 64 * 1024 * 1024


def assign_stations(
    cells: DataFrame, stations: DataFrame, prefilter: int = C.STATIONS_PREFILTER, cell_bound: int | None = None
) -> DataFrame:
    """Stations used by each cell: the ten nearest by degrees, ranked by great-circle distance, of which the nearest
    1, 3 or 5 are kept."""
    found = nearest_k(
        cells.select(F.col("cell_id").alias("id"), F.col("center_lat").alias("lat"), F.col("center_lon").alias("lon")),
        stations.select(F.col("station_id").alias("id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon")),
        prefilter,
        query_bound=cell_bound,
    )
    km = X.haversine_km(F.col("query_lat"), F.col("query_lon"), F.col("point_lat"), F.col("point_lon"))
    ranked = found.select("query_id", "point_id", km.alias("dist_km")).withColumn("_km", F.round("dist_km", 6))
    by_distance = Window.partitionBy("query_id").orderBy("_km", "point_id")
    return (
        ranked.select(
            "query_id",
            "point_id",
            "dist_km",
            F.row_number().over(by_distance).alias("rnk"),
            F.first("point_id").over(by_distance).alias("primary_station"),
            F.first("dist_km").over(by_distance).alias("primary_distance"),
        )
        .filter(F.col("rnk") <= X.station_tier(F.col("primary_distance")))
        .select(
            F.col("query_id").alias("cell_id"),
            F.col("point_id").alias("station_id"),
            "dist_km",
            "rnk",
            "primary_station",
            "primary_distance",
        )
    )


def assignments_are_small(cell_bound: int | None) -> bool:
    return cell_bound is not None and cell_bound * STATIONS_PER_CELL * ASSIGNMENT_BYTES <= BROADCAST_BYTES


def used_stations(weather: DataFrame, assignments: DataFrame, cell_bound: int | None = None) -> DataFrame:
    """Rows (readings or wide) of stations that some cell uses. Applied to the readings, all other stations drop out where
    they are scanned, before the pivot shuffles anything; at most five stations per cell remain."""
    used = assignments.select("station_id").distinct()
    return weather.join(F.broadcast(used) if assignments_are_small(cell_bound) else used, "station_id", "left_semi")


def interpolate(
    assignments: DataFrame,
    weather: DataFrame,
    mode: str = "idw",
    cell_bound: int | None = None,
    days: DataFrame | None = None,
) -> DataFrame:
    """Weather of every assigned cell on every day that any station reports.

    ``idw`` weighs the reporting stations of the cell by inverse squared distance; a measure missing at one of several
    stations is missing in the result. ``nearest`` uses the closest station alone. Days without a reporting station
    get the seasonal defaults of their month.

    Readings meet the assignments on the station key first, are folded to one row per cell and day (fixed-width
    buffers, combined before the shuffle), and only then join the cell x day spine on that same key. ``cell_bound`` is the
    cell count known from the grid's parameters: when it proves the assignment table small, the table is broadcast and
    the readings are never shuffled by station. ``days`` gives the days (a ``date`` column) when ``weather`` is already
    cut down to the stations in use.
    """
    used = assignments.select("cell_id", "station_id", "dist_km", "rnk")
    if mode == "nearest":
        used = used.filter(F.col("rnk") == 1)
    elif mode != "idw":
        raise ValueError(f"unknown interpolation mode: {mode}")
    used = used.select("cell_id", "station_id", "dist_km")
    if assignments_are_small(cell_bound):
        used = F.broadcast(used)
    readings = weather.select("station_id", "date", *MIXED_MEASURES)

    # Null at distance zero, which only a cell with a single station can have; the value is then taken as it is.
    weight = F.try_divide(F.lit(1.0), F.col("dist_km") * F.col("dist_km"))
    rows = F.count(F.lit(1))

    def mixed(measure):
        single = F.when(rows == 1, F.max(measure))
        several = F.sum(F.col(measure) * F.col("w")) / F.sum("w")
        return F.when(F.count(measure) == rows, single.otherwise(several)).alias(measure)

    reported = (
        readings.join(used, "station_id")
        .withColumn("w", weight)
        .groupBy("cell_id", "date")
        .agg(rows.cast("int").alias("n_used"), *[mixed(m) for m in MIXED_MEASURES])
    )
    # Distinct days are bounded by the calendar, so the list of them fits a scalar.
    day_list = (weather if days is None else days).agg(F.array_sort(F.collect_set("date"))).scalar()
    spine = assignments.filter(F.col("rnk") == 1).select(
        "cell_id", "primary_station", "primary_distance", F.explode(day_list).alias("date")
    )
    joined = spine.join(reported, ["cell_id", "date"], "left")

    n_used = F.coalesce("n_used", F.lit(0))
    has_station = n_used >= 1
    defaults = X.seasonal_defaults(F.month("date"))
    return joined.select(
        "cell_id",
        "date",
        *[
            F.when(has_station, F.col(m)).otherwise(defaults[m]).alias(m)
            for m in ("tmax", "tmin", "tavg", "temp_range", "prcp", "snwd")
        ],
        F.year("date").alias("year"),
        F.month("date").alias("month"),
        F.dayofyear("date").alias("day_of_year"),
        X.season(F.month("date")).alias("season"),
        F.when(has_station, F.col("data_completeness")).otherwise(defaults["data_completeness"]).alias(
            "data_completeness"
        ),
        F.when(n_used == 0, "seasonal_default")
        .when(n_used == 1, "nearest_station")
        .otherwise("distance_weighted")
        .alias("interpolation_method"),
        F.when(has_station, F.col("primary_station")).alias("nearest_station_id"),
        F.when(has_station, F.col("primary_distance")).alias("nearest_station_distance_km"),
        n_used.alias("station_count_used"),
        X.confidence(n_used, F.col("primary_distance")).alias("confidence_score"),
    )


def cell_confidence(
    assignments: DataFrame, station_days: DataFrame, days: DataFrame, mode: str = "idw", cell_bound: int | None = None
) -> DataFrame:
    """cell_id, avg_confidence, data_days: the mean over all days of what ``interpolate`` gives as confidence.

    It depends on the day only by how many of the cell's stations report, so days are counted by that number and neither the
    spine of cells and days nor any measure is needed. ``station_days``: one row per station and day with a report.
    """
    used = assignments.select("cell_id", "station_id", "rnk")
    used = (used.filter("rnk = 1") if mode == "nearest" else used).select("cell_id", "station_id")
    reports = (
        station_days.select("station_id", "date")
        .join(F.broadcast(used) if assignments_are_small(cell_bound) else used, "station_id")
        .groupBy("cell_id", "date")
        .agg(F.count("*").alias("n"))
        .groupBy("cell_id")
        .agg(F.count(F.when(F.col("n") == 1, 1)).alias("one"), F.count(F.when(F.col("n") > 1, 1)).alias("more"))
    )
    n_days = days.agg(F.count_distinct("date")).scalar()
    one, more = F.coalesce("one", F.lit(0)), F.coalesce("more", F.lit(0))
    of = lambda n: X.confidence(F.lit(n), F.col("primary_distance"))
    cells = assignments.filter("rnk = 1").select("cell_id", "primary_distance").join(reports, "cell_id", "left")
    total = one * of(1) + more * of(2) + (n_days - one - more) * of(0)
    return cells.select("cell_id", (total / n_days).alias("avg_confidence"), n_days.alias("data_days"))
