"""The batch from raw files to model data: raw text -> validated tables -> grid tables -> samples.

Each step writes its tables under ``out`` and the next reads them back, so a step can be run again on its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberline import config as C
from emberline.operators import fires, geo, profile, validate, weather
from emberline.plans.workspace import Workspace
from emberline.sources import declared, fire_files, sinks, station_text
from emberline.sources.tables import read_table


@dataclass(frozen=True)
class RawInputs:
    """Paths of the raw data; the daily path may be a folder or a glob of ``.dly`` files."""

    stations: str
    daily: str
    inventory: str | None = None
    fires: str | None = None
    collected: bool = False


def collect_daily(
    spark: SparkSession,
    raw: RawInputs,
    path: str,
    first_year: int = C.YEAR_FIRST,
    last_year: int = C.YEAR_LAST,
    bounds: C.Bounds = C.SOUTHERN_CANADA,
) -> DataFrame:
    """Keep the daily lines of known Canadian stations in the box and year range; returns the stations without metadata."""
    lines = station_text.read_lines(spark, raw.daily)
    known = validate.valid(
        station_text.parse_stations(station_text.read_lines(spark, raw.stations), bounds, min_len=84, strip=False)
    )
    kept, unknown = weather.match_stations(lines, known, bounds)
    sinks.write_daily_text(station_text.filter_daily_years(kept, first_year, last_year), path)
    return unknown


def collect_fires(
    raw: DataFrame,
    bounds: C.Bounds = C.SOUTHERN_CANADA,
    first_year: int = C.YEAR_FIRST,
    last_year: int = C.YEAR_LAST,
) -> DataFrame:
    """Collector rules on fire reports: sentinel dates out, inside the box (points) or touching it (shapes), year range."""
    kept = validate.drop_sentinel_fires(fire_files.rename_wkt(raw))
    if "LATITUDE" in kept.columns and "LONGITUDE" in kept.columns:
        lat, lon = (F.col(c).try_cast("double") for c in ("LATITUDE", "LONGITUDE"))
        kept = kept.filter(lat.between(bounds.lat_min, bounds.lat_max) & lon.between(bounds.lon_min, bounds.lon_max))
    else:
        kept = kept.filter(geo.polygon_meets_box("geometry_wkt", bounds))
    return kept.filter(F.col("YEAR").try_cast("double").between(first_year, last_year))


def place_shapes(raw: DataFrame) -> DataFrame:
    """Option for shape files, which have no coordinates: the middle of the envelope stands for the fire's place."""
    lat, lon = geo.envelope_center("geometry_wkt")
    return raw.withColumns({"LATITUDE": lat, "LONGITUDE": lon})


def collect(spark: SparkSession, raw: RawInputs, out: str) -> RawInputs:
    """The collector's part: daily lines of known Canadian stations in the box and years, and the stations without metadata.
    Returns the inputs with the collected daily lines in place of the raw ones."""
    unknown = collect_daily(spark, raw, f"{out}/collected/daily")
    sinks.write_csv(unknown, f"{out}/collected/unknown_stations")
    return replace(raw, daily=f"{out}/collected/daily/*", collected=True)


def hand_on(df: DataFrame, out: str, name: str) -> None:
    """A validated table: parquet for the next step, and from it a CSV export."""
    sinks.write_table(df, f"{out}/validated/tables/{name}")
    sinks.write_csv(read_table(df.sparkSession, f"{out}/validated/tables/{name}"), f"{out}/validated/{name}")


def validate_raw(spark: SparkSession, raw: RawInputs, out: str, daily_mode: str = "tokens") -> None:
    """Validated tables and the report: rows processed, valid and removed per table, and every rejected row. Of collected inputs,
    only Canadian stations and the fires that pass the collector's rules are looked at."""
    lines = station_text.read_lines(spark, raw.stations)
    stations = station_text.parse_stations(lines.filter(F.col("value").startswith("CA")) if raw.collected else lines)
    hand_on(validate.valid(stations).drop("source_file", "line_no"), out, "stations")
    classified = {"stations": stations}
    rejects = [validate.reject_rows(stations, "stations", "station_id").withColumnRenamed("station_id", "detail")]
    if raw.inventory is not None:
        inventory = station_text.parse_inventory(station_text.read_lines(spark, raw.inventory))
        hand_on(validate.valid(inventory).drop("source_file", "line_no"), out, "station_inventory")
        classified["station_inventory"] = inventory
        rejects.append(
            validate.reject_rows(inventory, "station_inventory", "station_id").withColumnRenamed("station_id", "detail")
        )
    daily = station_text.parse_daily(station_text.read_lines(spark, raw.daily), daily_mode)
    hand_on(weather.weather_wide(daily), out, "weather_records")
    if raw.fires is not None:
        reports, skipped = fire_files.read_fire_files(spark, raw.fires)
        sinks.write_csv(skipped, f"{out}/validated/skipped_files")
        if reports is not None:
            fire_rows = validate.classify_fires(collect_fires(reports) if raw.collected else fire_files.rename_wkt(reports))
            hand_on(validate.valid(fire_rows), out, "wildfire_records")
            classified["wildfires"] = fire_rows
            rejects.append(
                validate.reject_rows(fire_rows, "wildfires", "NFDBFIREID").withColumnRenamed("NFDBFIREID", "detail")
            )
    sinks.write_csv(validate.processed_counts(classified), f"{out}/validated/report_counts")
    sinks.write_csv(validate.rule_counts(classified), f"{out}/validated/report_rules")
    every = rejects[0]
    for part in rejects[1:]:
        every = every.unionByName(part)
    sinks.write_csv(every, f"{out}/validated/report_rejects")


# Tables whose rows are checked as they are written.
DECLARED = {
    "stations": declared.STATIONS, "weather_wide": declared.WEATHER_WIDE, "station_neighbors": declared.STATION_NEIGHBORS,
    "grid_cells": declared.GRID_CELLS, "cell_station": declared.CELL_STATION, "fire_events": declared.FIRE_EVENTS,
    "cell_fire": declared.CELL_FIRE,
}


def keep(df: DataFrame, out: str, name: str, write: Callable[[DataFrame, str], None] = sinks.write_table) -> DataFrame:
    """Store a declared table; a run that fails leaves the one before it."""
    return declared.write_declared(df, f"{out}/tables/{name}", DECLARED[name], write)


def stored(spark: SparkSession, out: str, name: str, *columns: str) -> DataFrame:
    """A stored table."""
    path = f"{out}/tables/{name}"
    if name in DECLARED:
        return declared.read_declared(spark, path, DECLARED[name], *columns)
    return read_table(spark, path, *columns)


def build_station_tables(spark: SparkSession, out: str) -> None:
    """Station, weather and neighbour tables, and the run's counts as metadata. Pairs of stations are not stored: their number grows with
    the square of the density, and nothing reads them; ``geo.pairs_within`` gives them when asked."""
    def validated(name):
        return read_table(spark, f"{out}/validated/tables/{name}")

    stations = keep(validated("stations"), out, "stations")
    by_station = partial(sinks.write_weather, key="station_id")
    counted = {
        "stations": (stations, "Number of weather stations"),
        "weather_records": (keep(weather.enrich(validated("weather_records")), out, "weather_wide", by_station), "Number of weather records"),
        "station_neighbors": (keep(geo.station_neighbors(stations), out, "station_neighbors"), "Number of neighbor relations"),
    }
    sinks.write_table(profile.table_counts(counted), f"{out}/tables/metadata")


def workspace_of(spark: SparkSession, out: str, **options) -> Workspace:
    """The grid and sample tables over the station tables and validated fires of ``out``."""
    reports = read_table(spark, f"{out}/validated/tables/wildfire_records").withColumns(
        {c: F.col(c).cast("double") for c in ("LATITUDE", "LONGITUDE", "SIZE_HA")}
    )
    return Workspace(
        spark,
        stored(spark, out, "stations", "station_id", "latitude", "longitude"),
        stored(spark, out, "weather_wide"),
        fires.fires_from_reports(reports),
        **options,
    )


def build_grid_tables(ws: Workspace, out: str) -> None:
    keep(ws.cells, out, "grid_cells")
    keep(ws.assigned, out, "cell_station")
    sinks.write_weather(ws.weather, f"{out}/tables/weather_data")
    keep(sinks.with_json_cells(ws.events), out, "fire_events")
    keep(ws.cell_fire, out, "cell_fire")


def build_samples(ws: Workspace, out: str) -> None:
    """Training and test samples as tables, from these as CSV, and their metadata as JSON."""
    made = {}
    for kind in ("train", "test"):
        sinks.write_table(ws.samples(kind), f"{out}/samples/tables/{kind}")
        made[kind] = read_table(ws.spark, f"{out}/samples/tables/{kind}")
        sinks.write_csv(made[kind], f"{out}/samples/{kind}")
    profile.dataset_metadata(made["train"], made["test"]).coalesce(1).write.mode("overwrite").text(f"{out}/samples/metadata")


def run(spark: SparkSession, raw: RawInputs, out: str, daily_mode: str = "tokens", **options) -> Workspace:
    """All steps in order, the collector's first."""
    raw = collect(spark, raw, out)
    validate_raw(spark, raw, out, daily_mode)
    build_station_tables(spark, out)
    ws = workspace_of(spark, out, **options)
    build_grid_tables(ws, out)
    build_samples(ws, out)
    return ws
