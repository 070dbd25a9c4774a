"""Fires on the grid: affected cells, events, cell relations and burning days."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from emberline import config as C
from emberline.functions import exprs as X
from emberline.operators.geo import bin_join

LAT_BIN, LON_BIN = 0.25, 0.4
# Slightly less than the shortest degree of latitude on the sphere used, so that the reach is never too small.
KM_PER_DEGREE_FLOOR = 111.0


def fires_from_reports(reports: DataFrame) -> DataFrame:
    """Validated fire reports under the names used here. A report is known by its file and line; a table without
    ``source_file`` is one file."""
    file = F.col("source_file") if "source_file" in reports.columns else F.lit("")
    return reports.select(
        F.col("NFDBFIREID").alias("fire_id"),
        file.alias("source_file"),
        "line_no",
        F.col("LATITUDE").alias("latitude"),
        F.col("LONGITUDE").alias("longitude"),
        F.col("REP_DATE").alias("rep_date"),
        F.col("OUT_DATE").alias("out_date"),
        F.col("SIZE_HA").alias("size_ha"),
        F.col("FIRE_TYPE").alias("fire_type"),
    )


def prepare_fires(fires: DataFrame) -> DataFrame:
    """Dates, size, radius and type of each fire; a fire with an unreadable date is dropped."""
    out_text = F.trim(F.col("out_date").cast("string"))
    no_end = out_text.isNull() | (out_text == "") | (out_text == C.BLANK_OUT_DATE)
    start = X.to_day(F.col("rep_date").cast("string"))
    if "source_file" not in fires.columns:
        fires = fires.withColumn("source_file", F.lit(""))
    return (
        fires.select(
            "fire_id",
            "source_file",
            "line_no",
            "latitude",
            "longitude",
            start.alias("start_date"),
            F.when(no_end, start).otherwise(X.to_day(out_text)).alias("end_date"),
            X.burn_size_ha(F.col("size_ha")).alias("size_ha"),
            F.coalesce(F.when(F.col("fire_type") != "", F.col("fire_type")), F.lit("Unknown")).alias("fire_type"),
        )
        .filter(F.col("start_date").isNotNull() & F.col("end_date").isNotNull())
        .withColumn("radius_km", X.fire_radius_km(F.col("size_ha")))
    )


def near_cells(fires: DataFrame, cells: DataFrame) -> DataFrame:
    """Fires no further than one degree outside the extent of the cells."""
    extent = cells.agg(
        F.struct(
            F.min("center_lat").alias("lat_lo"),
            F.max("center_lat").alias("lat_hi"),
            F.min("center_lon").alias("lon_lo"),
            F.max("center_lon").alias("lon_hi"),
        )
    ).scalar()
    return fires.filter(
        F.col("latitude").between(extent["lat_lo"] - 1, extent["lat_hi"] + 1)
        & F.col("longitude").between(extent["lon_lo"] - 1, extent["lon_hi"] + 1)
    )


# A cell is about 48 bytes in a broadcast hash table.
CELL_BYTES = 48
BROADCAST_BYTES = 64 * 1024 * 1024


def burned_lines(fires: DataFrame, cells: DataFrame, cell_bound: int | None = None) -> DataFrame:
    """One row per fire report that reaches a cell: its affected cells (sorted) and the nearest of them.

    The list of a report is bounded by the cells within 20 km of one point. Grid cells are evenly spaced, so no bin of them
    is crowded; when ``cell_bound`` (the cell count known from the grid's parameters) proves them few, they are
    broadcast and the fires stay where they are, however many lie in one place. Otherwise a bin with very many fires is a
    join key skewed on the left only, which adaptive execution splits.
    """
    prepared = near_cells(prepare_fires(fires), cells)
    lat_reach = F.col("radius_km") / F.lit(KM_PER_DEGREE_FLOOR)
    widest = F.least(F.abs("lat") + lat_reach, F.lit(89.0))
    lon_reach = F.col("radius_km") / (F.lit(KM_PER_DEGREE_FLOOR) * F.cos(F.radians(widest)))
    candidates = bin_join(
        prepared.withColumnsRenamed({"latitude": "lat", "longitude": "lon"}),
        cells.select("cell_id", F.col("center_lat").alias("lat"), F.col("center_lon").alias("lon")),
        lat_reach,
        lon_reach,
        LAT_BIN,
        LON_BIN,
        split_rows=None,
        small_right=cell_bound is not None and cell_bound * CELL_BYTES <= BROADCAST_BYTES,
    )
    km = X.haversine_km(F.col("l.lat"), F.col("l.lon"), F.col("r.lat"), F.col("r.lon"))
    hits = candidates.select("l.*", "r.cell_id", km.alias("km")).filter(F.col("km") <= F.col("radius_km"))
    return hits.groupBy(
        "source_file", "line_no", "fire_id", "start_date", "end_date", "size_ha", "fire_type", "lat", "lon"
    ).agg(
        F.sort_array(F.collect_list("cell_id")).alias("affected_cells"),
        F.min(F.struct(F.round("km", 6).alias("km"), "cell_id"))["cell_id"].alias("center_cell_id"),
    )


def _first_per(df: DataFrame, *key: str) -> DataFrame:
    """The earliest line of each key, files in order of their names. The rank limit is applied before the shuffle too, so a key repeated very often
    sends one row per task."""
    order = Window.partitionBy(*key).orderBy("source_file", "line_no")
    return df.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") == 1).drop("_n")


def fire_events(burned: DataFrame) -> DataFrame:
    """One row per fire id: its first report that reaches a cell."""
    return _first_per(burned, "fire_id").select(
        "fire_id",
        "center_cell_id",
        "start_date",
        "end_date",
        F.col("size_ha").alias("total_size_ha"),
        "fire_type",
        F.col("lat").alias("latitude"),
        F.col("lon").alias("longitude"),
        "affected_cells",
    )


def cell_fires(burned: DataFrame) -> DataFrame:
    """One row per cell and fire id, with the fire's size shared evenly among its cells."""
    exploded = burned.select(
        F.explode("affected_cells").alias("cell_id"),
        "fire_id",
        (F.col("size_ha") / F.size("affected_cells")).alias("fire_size_ha"),
        F.col("start_date").alias("fire_start_date"),
        F.col("end_date").alias("fire_end_date"),
        "source_file",
        "line_no",
    )
    return _first_per(exploded, "cell_id", "fire_id").drop("source_file", "line_no")


def fire_days(cell_fire: DataFrame, first_day: str, last_day: str) -> DataFrame:
    """Number of fires burning per cell and day within [first_day, last_day].

    Equal intervals of a cell are counted before they are spread over days, and intervals are cut to the range first, so
    neither a cell with very many fires nor a wild end date makes a long row list.
    """
    lo, hi = F.lit(first_day).cast("date"), F.lit(last_day).cast("date")
    intervals = (
        cell_fire.select(
            "cell_id",
            F.greatest("fire_start_date", lo).alias("d1"),
            F.least("fire_end_date", hi).alias("d2"),
        )
        .filter(F.col("d1") <= F.col("d2"))
        .groupBy("cell_id", "d1", "d2")
        .agg(F.count("*").alias("n"))
    )
    return (
        intervals.select("cell_id", F.explode(F.sequence("d1", "d2")).alias("date"), "n")
        .groupBy("cell_id", "date")
        .agg(F.sum("n").alias("n_fires"))
    )


def fire_status(keys: DataFrame, days: DataFrame) -> DataFrame:
    """Whether any fire burns on each (cell_id, date) of ``keys``."""
    return keys.join(days, ["cell_id", "date"], "left").select(
        "cell_id", "date", (F.coalesce("n_fires", F.lit(0)) > 0).cast("int").alias("fire_occurred")
    )


def burning_spans(cell_fire: DataFrame) -> DataFrame:
    """cell_id, year, first_day, last_day: the days with any fire, as disjoint spans that end with the year.

    Of intervals that begin on one day of a cell only the longest counts, folded before the shuffle, and spans are cut at the turn of the year, so a
    window holds at most 366 rows, whatever the number of fires of a cell. An interval without a first or last day has no span.
    """
    longest = (
        cell_fire.filter(F.col("fire_start_date") <= F.col("fire_end_date"))
        .groupBy("cell_id", F.col("fire_start_date").alias("d1"))
        .agg(F.max("fire_end_date").alias("d2"))
        .select("cell_id", "d1", "d2", F.explode(F.sequence(F.year("d1"), F.year("d2"))).alias("year"))
        .groupBy("cell_id", "year", F.greatest("d1", F.make_date("year", F.lit(1), F.lit(1))).alias("d1"))
        .agg(F.max(F.least("d2", F.make_date("year", F.lit(12), F.lit(31)))).alias("d2"))
    )
    in_order = Window.partitionBy("cell_id", "year").orderBy("d1")
    before = F.max("d2").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    return (
        longest.withColumn("begins", F.when(F.col("d1") <= before, 0).otherwise(1))
        .withColumn("span", F.sum("begins").over(in_order))
        .groupBy("cell_id", "year", "span")
        .agg(F.min("d1").alias("first_day"), F.max("d2").alias("last_day"))
        .drop("span")
    )


def fire_status_in_spans(keys: DataFrame, cell_fire: DataFrame) -> DataFrame:
    """``fire_status`` of distinct (cell_id, date) keys by the intervals themselves: no interval becomes days.

    An as-of join: the spans and the keys of a cell and year stand in one order of days, and each key looks back to the last span that began.
    """
    spans = burning_spans(cell_fire).select(
        "cell_id", "year", F.col("first_day").alias("date"), F.lit(0).alias("is_key"), "last_day"
    )
    asked = keys.select(
        "cell_id", F.year("date").alias("year"), "date", F.lit(1).alias("is_key"), F.lit(None).cast("date").alias("last_day")
    )
    back = Window.partitionBy("cell_id", "year").orderBy("date", "is_key")
    return (
        spans.unionByName(asked)
        .withColumn("until", F.last("last_day", ignorenulls=True).over(back))
        .filter(F.col("is_key") == 1)
        .select("cell_id", "date", F.coalesce(F.col("date") <= F.col("until"), F.lit(False)).cast("int").alias("fire_occurred"))
    )


def cells_with_history(cell_fire: DataFrame, events: DataFrame) -> DataFrame:
    """Cells touched by a recorded event."""
    return cell_fire.join(events.select("fire_id"), "fire_id", "left_semi").select("cell_id").distinct()
