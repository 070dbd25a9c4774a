"""The chain of tables from stations, readings and fires to samples, each computed once.

Small or shared tables (assignments, cell-fire relations, targets, sample weather) are written to the session's shared folder and
read back, as the stages of a batch pipeline hand tables to each other; large ones that are read once stay lazy.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberline import config as C
from emberline.operators import features, fires, grid, interpolate as ip, sampling, weather
from emberline.session import reliable_cut


class Workspace:
    def __init__(
        self,
        spark: SparkSession,
        stations: DataFrame,
        station_weather: DataFrame | None,
        fire_reports: DataFrame | Callable[[], DataFrame],
        km: float = 10.0,
        bounds: C.Bounds = C.SOUTHERN_CANADA,
        confidence_min: dict[str, float] | None = None,
        interpolation: str = "idw",
        temporal_split: bool = False,
        dedupe_fires: bool = False,
        neighbor_lag_years: int = 0,
        readings: DataFrame | None = None,
    ):
        """``stations``: station_id, latitude, longitude. ``fire_reports``: valid fires as ``fires.fires_from_reports`` names
        them, or a function that builds them when they are first needed. Weather comes either as ``station_weather``, enriched wide rows, or as accepted ``readings`` in long form, which
        are then pivoted here, after the readings of stations that no cell uses are gone."""
        self.spark, self.km, self.bounds = spark, km, bounds
        self.stations, self._fire_reports = stations, fire_reports
        self._station_weather, self._readings = station_weather, readings
        # The days any station reports; read off the readings, this needs no pivot.
        self.days = (station_weather if readings is None else readings).select("date")
        self.confidence_min, self.interpolation = confidence_min, interpolation
        self.temporal_split, self.dedupe_fires, self.neighbor_lag_years = temporal_split, dedupe_fires, neighbor_lag_years
        self.cell_bound = grid.count_cells(km, bounds)
        self._dates: dict[str, DataFrame] = {}

    @cached_property
    def cells(self) -> DataFrame:
        """Generated from parameters without a shuffle, so cheaper to repeat than to store."""
        return grid.grid_cells(self.spark, self.km, self.bounds)

    @cached_property
    def land(self) -> DataFrame:
        return grid.land_cells(self.cells)

    @cached_property
    def fire_reports(self) -> DataFrame:
        return self._fire_reports() if callable(self._fire_reports) else self._fire_reports

    @cached_property
    def station_weather(self) -> DataFrame:
        """The wide readings of the stations in use, as a table: at most five stations per cell, interpolated more than once."""
        if self._readings is None:
            rows = ip.used_stations(self._station_weather, self.assigned, self.cell_bound)
        else:
            kept = ip.used_stations(self._readings, self.assigned, self.cell_bound)
            rows = weather.enrich(weather.weather_wide(kept))
        return reliable_cut(rows, "station_weather")

    @cached_property
    def assigned(self) -> DataFrame:
        """At most five rows per cell, read for the spine and for the readings."""
        return reliable_cut(ip.assign_stations(self.land, self.stations, cell_bound=self.cell_bound), "cell_station")

    @cached_property
    def weather(self) -> DataFrame:
        """Every cell and day; lazy, so that a reader of few columns computes few columns."""
        return ip.interpolate(self.assigned, self.station_weather, self.interpolation, self.cell_bound, self.days)

    @cached_property
    def burned_lines(self) -> DataFrame:
        return fires.burned_lines(self.fire_reports, self.land, self.cell_bound)

    @cached_property
    def burned(self) -> DataFrame:
        return reliable_cut(self.burned_lines, "burned")

    @property
    def events(self) -> DataFrame:
        return fires.fire_events(self.burned)

    @cached_property
    def cell_fire(self) -> DataFrame:
        return reliable_cut(fires.cell_fires(self.burned), "cell_fire")

    @cached_property
    def fire_days(self) -> DataFrame:
        """Burning days from the years of history before the first asked day to the last asked day. Asked are the reported days
        and all days a sample may take."""
        reported = self.days.agg(F.min("date").alias("first"), F.max("date").alias("last")).first()
        sampled = [*(f"{C.SAMPLE_YEARS[0]}-01-01", f"{C.SAMPLE_YEARS[1]}-12-31"), *(d for pair in C.WATER_DATES.values() for d in pair)]
        known = sorted([*sampled, *(str(d) for d in (reported.first, reported.last) if d is not None)])
        first_year = int(known[0][:4]) - C.HISTORY_YEARS
        return reliable_cut(fires.fire_days(self.cell_fire, f"{first_year}-01-01", known[-1]), "fire_days")

    @property
    def station_days(self) -> DataFrame:
        """One row per station and day with a report; off the readings this needs no pivot."""
        if self._readings is None or "station_weather" in self.__dict__:
            return self.station_weather.select("station_id", "date")
        return ip.used_stations(self._readings, self.assigned, self.cell_bound).select("station_id", "date").distinct()

    @property
    def stats(self) -> DataFrame:
        confidence = ip.cell_confidence(self.assigned, self.station_days, self.days, self.interpolation, self.cell_bound)
        return sampling.cell_stats(self.cells, confidence, self.cell_fire)

    @cached_property
    def targets(self) -> DataFrame:
        """Bounded by the quotas."""
        return reliable_cut(sampling.target_cells(self.stats, confidence_min=self.confidence_min), "targets")

    @cached_property
    def neighbors(self) -> DataFrame:
        asked = self.targets.filter(F.col("terrain_type") != "water").select("cell_id", "center_lat", "center_lon")
        return reliable_cut(grid.lattice_neighbors(asked, self.km, self.bounds), "neighbors")

    @cached_property
    def sample_weather(self) -> DataFrame:
        """Weather of the target cells and their neighbours only: at most nine cells per target."""
        wanted = (
            self.targets.select("cell_id")
            .unionByName(self.neighbors.select(F.col("neighbor_id").alias("cell_id")))
            .distinct()
        )
        near = self.assigned.join(wanted, "cell_id", "left_semi")
        rows = ip.interpolate(near, self.station_weather, self.interpolation, self.cell_bound, self.days)
        return reliable_cut(rows.select("cell_id", "date", "tmax", "tavg", "prcp"), "sample_weather")

    def dates(self, kind: str) -> DataFrame:
        """Drawn once per kind and stored."""
        if kind not in self._dates:
            drawn = sampling.sample_dates(self.targets, self.sample_weather, self.cell_fire, kind, self.temporal_split)
            self._dates[kind] = reliable_cut(drawn, f"dates_{kind}")
        return self._dates[kind]

    def samples(self, kind: str) -> DataFrame:
        return features.training_samples(
            self.dates(kind), self.cells, self.sample_weather, self.cell_fire, self.fire_days,
            self.neighbors, self.dedupe_fires, self.neighbor_lag_years,
        )

    def sample_keys(self, kind: str) -> DataFrame:
        return (
            features.drop_leap_day(self.dates(kind).filter(F.col("terrain_type") != "water"))
            .select("cell_id", "target_date")
            .distinct()
        )
