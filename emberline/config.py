"""Parameters of every step, in one place.

The numbers below are fixed values: they decide the results, so they are stated plainly.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields


@dataclass(frozen=True)
class Bounds:
    """A latitude / longitude box; all four edges are inclusive."""

    lat_min: float
    lat_max: float
    lon_min: float
    lon_max: float


# Study area and named test regions.
SOUTHERN_CANADA = Bounds(41.75, 60.0, -137.72, -52.67)
REGIONS = {
    "toronto": Bounds(43.0, 44.0, -80.0, -78.0),
    "vancouver": Bounds(49.0, 50.0, -125.0, -122.0),
    "calgary": Bounds(50.0, 51.0, -115.0, -113.0),
    "montreal": Bounds(45.0, 46.0, -74.0, -73.0),
}

YEAR_FIRST, YEAR_LAST = 2022, 2025

# Daily elements, the accepted range of each after unit conversion, and the flag of a complete reading.
ELEMENTS = ("TMAX", "TMIN", "TAVG", "PRCP", "SNWD")
ELEMENT_RANGE = {
    "TMAX": (-60.0, 45.0),
    "TMIN": (-60.0, 45.0),
    "TAVG": (-60.0, 45.0),
    "PRCP": (0.0, 500.0),
    "SNWD": (0.0, 500.0),
}
TENTHS_ELEMENTS = ("TMAX", "TMIN", "TAVG", "PRCP")
COMPLETE_FLAG = "C"
MISSING_VALUE = -9999.0

ELEVATION_MISSING = "-999.9"
ELEVATION_RANGE = (-100.0, 5000.0)

# Fires.
FIRE_SIZE_RANGE_HA = (0.0, 1_000_000.0)
FIRE_RADIUS_CAP_KM = 20.0
BLANK_OUT_DATE = "0000/00/00"
WKT_PREFIXES = ("POINT", "POLYGON", "MULTIPOINT", "MULTIPOLYGON", "LINESTRING", "MULTILINESTRING")
FIRE_REQUIRED = ("LATITUDE", "LONGITUDE", "YEAR", "MONTH", "DAY", "SIZE_HA")
FIRE_TEXT_COLUMNS = (
    "NFDBFIREID", "SRC_AGENCY", "FIRE_ID", "FIRENAME", "REP_DATE", "ATTK_DATE", "OUT_DATE", "CAUSE", "CAUSE2",
    "FIRE_TYPE", "RESPONSE", "PROTZONE", "PRESCRIBED", "MORE_INFO", "CFS_NOTE1", "CFS_NOTE2", "ACQ_DATE",
    "layer", "omit",
)
DATE_SENTINELS = (0, -9999)

# Geography.
EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.32
PAIR_LIMIT_KM = 500.0
NEIGHBORS_PER_STATION = 10
STATIONS_PREFILTER = 10
LAND_TERRAINS = ("land", "urban", "forest")

# Terrain boxes: (lat_min, lat_max, lon_min, lon_max); None leaves that side open.
WATER_BOXES = (
    (41.75, 49.0, -92.0, -76.0),    # great lakes
    (None, None, -65.0, None),      # atlantic coast
    (48.0, None, None, -125.0),     # pacific coast
    (58.0, None, None, None),       # arctic waters
)
URBAN_BOXES = (
    (43.0, 44.5, -80.0, -78.5),     # toronto
    (49.0, 49.5, -123.5, -122.5),   # vancouver
    (45.3, 45.7, -74.0, -73.5),     # montreal
    (51.0, 51.2, -114.2, -113.8),   # calgary
    (53.4, 53.7, -113.7, -113.3),   # edmonton
    (50.0, 50.5, -97.0, -96.5),     # winnipeg
    (46.8, 47.0, -71.2, -71.0),     # quebec city
    (44.6, 44.8, -63.8, -63.4),     # halifax
)
FOREST_LAT_MIN = 45.0
TERRAIN_CODE = {"forest": 1, "land": 2, "urban": 3, "water": 4}

# Samples and features.
TARGET_CELLS = 500
TERRAIN_SHARE = {"forest": 0.40, "land": 0.25, "urban": 0.20, "water": 0.15}
CONFIDENCE_MIN = {"forest": 0.4, "land": 0.3, "urban": 0.7, "water": 0.1}
WATER_CELLS = 50
MIN_DAYS_TARGET = 100
MIN_DAYS_POOL = 50
POOL_SIZE = 5000
POOL_SHARE = {"forest": 0.40, "tundra": 0.25, "urban": 0.15, "water": 0.20}
DATES_PER_CELL = {"train": 10, "test": 20}
WATER_DATES = {"train": ("2022-06-01", "2023-08-31"), "test": ("2024-06-01", "2024-08-31")}
SAMPLE_YEARS = (2022, 2024)
SPLIT_PERIOD = {"train": ("2022-01-01", "2023-12-31"), "test": ("2024-01-01", "2024-12-31")}
WINDOW_DAYS = 7
HISTORY_YEARS = 3
CELL_NEIGHBORS = 8
SAMPLE_SEED = 42

SAMPLE_COLUMNS = (
    "cell_id", "target_date", "terrain_type", "fire_occurred",
    "year_1_avg_temp", "year_1_max_temp", "year_1_total_precip", "year_1_dry_days", "year_1_fire_occurred",
    "year_2_avg_temp", "year_2_max_temp", "year_2_total_precip", "year_2_dry_days", "year_2_fire_occurred",
    "year_3_avg_temp", "year_3_max_temp", "year_3_total_precip", "year_3_dry_days", "year_3_fire_occurred",
    "avg_temp_trend", "fire_frequency", "avg_fire_size",
    "neighbor_avg_temp", "neighbor_max_temp", "neighbor_total_precip", "neighbor_dry_days",
    "neighbor_fire_frequency", "neighbor_terrain_types",
    "terrain_type_encoded", "area_km2", "historical_fire_frequency", "elevation",
    "is_water", "urban_flag", "elevation_m", "distance_to_urban_km",
)
FEATURE_COLUMNS = SAMPLE_COLUMNS[4:]


@dataclass(frozen=True)
class ModelConfig:
    """Settings of one boosted-tree model; the first five fields are searched over."""

    max_depth: int = 6
    n_estimators: int = 100
    learning_rate: float = 0.1
    subsample: float = 0.8
    colsample: float = 0.8
    reg_alpha: float = 0.0
    reg_lambda: float = 0.0
    early_stopping_rounds: int = 20
    seed: int = 42

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, values: dict) -> "ModelConfig":
        return cls(**{f.name: values[f.name] for f in fields(cls) if f.name in values})


# Search space: name -> (low, high, largest mutation step, is integer). Settings that Spark's trees do not have (L1, L2) are
# carried by ModelConfig but not searched over.
SEARCH_SPACE = {
    "max_depth": (3, 15, 2, True),
    "n_estimators": (50, 500, 50, True),
    "learning_rate": (0.01, 0.3, 0.05, False),
    "subsample": (0.6, 1.0, 0.1, False),
    "colsample": (0.6, 1.0, 0.1, False),
}


@dataclass(frozen=True)
class SearchConfig:
    population_size: int = 50
    max_generations: int = 10
    test_samples_per_generation: int = 200
    elite_count: int = 5
    default_members: int = 5
    tournament_size: int = 3
    mutation_rate: float = 0.1
    crossover_rate: float = 0.8
    patience: int = 3
    parallel_fits: int = 4
    # No fit begins later; the stated target of a whole search.
    max_seconds: float = 5 * 3600.0
    seed: int = 42
