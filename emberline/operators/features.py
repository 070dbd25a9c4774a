"""Features of (cell, day) samples, built for all samples at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from emberline import config as C
from emberline.functions import exprs as X


def drop_leap_day(samples: DataFrame) -> DataFrame:
    """Samples on 29 February have no same day in the years before and are left out."""
    return samples.filter(~((F.month("target_date") == 2) & (F.day("target_date") == 29)))


def _years_back(day: Column, years: Column) -> Column:
    return F.make_date(F.year(day) - years, F.month(day), F.day(day))


def _with_fire_weight(weather: DataFrame, days: DataFrame, dedupe_fires: bool) -> DataFrame:
    """Weather rows with the number of fires burning and the weight of the row: a day under several fires counts once per
    fire, as joining the intervals would make it, without making the rows."""
    joined = weather.join(days, ["cell_id", "date"], "left").withColumn("n_fires", F.coalesce("n_fires", F.lit(0)))
    weight = F.lit(1).cast("long") if dedupe_fires else F.greatest(F.col("n_fires"), F.lit(1))
    return joined.withColumn("w", weight)


def _weighted_mean(value: str, hit: Column) -> Column:
    present = hit & F.col(value).isNotNull()
    return F.try_divide(F.sum(F.when(present, F.col(value) * F.col("w"))), F.sum(F.when(present, F.col("w"))))


def _total(value: Column, hit: Column) -> Column:
    return F.coalesce(F.sum(F.when(hit, value)), F.lit(0)).cast("double")


# What a looked-up day is to its sample: the day itself, a day of the window 1, 2, ... years back, or the day at a neighbour.
OWN_DAY, AROUND = 0, -1


def _asked(keys: DataFrame, neighbors: DataFrame | None, history: bool, own_day: bool, lag_years: int) -> DataFrame:
    """All (cell, day) look-ups of all samples: sample_cell, target_date, role, cell_id, date."""
    own, day = F.col("cell_id"), F.col("target_date")
    entry = lambda role, cell, date: F.struct(role.alias("role"), cell.alias("cell"), date.alias("date"))
    wanted = []
    if own_day:
        wanted.append(F.array(entry(F.lit(OWN_DAY), own, day)))
    if history:
        span = F.sequence(F.lit(-C.WINDOW_DAYS), F.lit(C.WINDOW_DAYS))

        def window(back: int) -> Column:
            middle = _years_back(day, F.lit(back))
            return F.transform(span, lambda shift: entry(F.lit(back), own, F.date_add(middle, shift)))

        wanted += [window(back) for back in range(1, C.HISTORY_YEARS + 1)]
    if neighbors is not None:
        # A row per target cell with its few neighbours.
        lists = neighbors.groupBy("cell_id").agg(F.collect_list("neighbor_id").alias("_around"))
        keys = keys.join(lists, "cell_id", "left")
        on = day if lag_years == 0 else _years_back(day, F.lit(lag_years))
        wanted.append(F.transform(F.coalesce("_around", F.array().cast("array<long>")), lambda cell: entry(F.lit(AROUND), cell, on)))
    return keys.select(
        F.col("cell_id").alias("sample_cell"), "target_date", F.explode(F.concat(*wanted)).alias("a")
    ).select("sample_cell", "target_date", "a.role", F.col("a.cell").alias("cell_id"), "a.date")


def _yearly_parts() -> list[Column]:
    parts = []
    for back in range(1, C.HISTORY_YEARS + 1):
        hit = F.col("role") == back
        rows = F.count(F.when(hit, 1))
        parts += [
            F.when(rows == 0, 0.0).otherwise(_weighted_mean("tavg", hit)).alias(f"year_{back}_avg_temp"),
            F.when(rows == 0, 0.0).otherwise(F.max(F.when(hit, F.col("tmax")))).alias(f"year_{back}_max_temp"),
            _total(F.col("prcp") * F.col("w"), hit).alias(f"year_{back}_total_precip"),
            _total(F.col("w"), hit & (F.col("prcp") < 1.0)).alias(f"year_{back}_dry_days"),
            F.coalesce(F.max(F.when(hit, F.least("n_fires", F.lit(1)))), F.lit(0)).cast("double").alias(
                f"year_{back}_fire_occurred"
            ),
        ]
    return parts


def _around_parts() -> list[Column]:
    hit = F.col("role") == AROUND
    found = F.count(F.when(hit, 1)) > 0
    or_zero = lambda value, name: F.when(found, value).otherwise(0.0).alias(f"neighbor_{name}")
    return [
        or_zero(_weighted_mean("tmax", hit), "avg_temp"),
        or_zero(F.max(F.when(hit, F.col("tmax"))), "max_temp"),
        or_zero(_total(F.col("prcp") * F.col("w"), hit), "total_precip"),
        or_zero(_total(F.col("w"), hit & (F.col("prcp") < 1.0)), "dry_days"),
        or_zero(F.try_divide(_total(F.col("w"), hit & (F.col("n_fires") > 0)), F.sum(F.when(hit, F.col("w")))), "fire_frequency"),
        or_zero(F.lit(1.0), "terrain_types"),
    ]


def _looked_up(
    keys: DataFrame, weather: DataFrame, days: DataFrame, dedupe_fires: bool, neighbors: DataFrame | None = None,
    history: bool = False, own_day: bool = False, lag_years: int = 0,
) -> DataFrame:
    """cell_id, target_date and the asked features of every sample of which any looked-up day has weather.

    All roles are exact (cell, day) keys of one table, so there is one join to the weather and its fires, and one conditional aggregation, whatever
    is asked for.
    """
    asked = _asked(keys, neighbors, history, own_day, lag_years)
    known = _with_fire_weight(weather.select("cell_id", "date", "tavg", "tmax", "prcp"), days, dedupe_fires)
    parts = (_yearly_parts() if history else []) + (_around_parts() if neighbors is not None else [])
    if own_day:
        hit = F.col("role") == OWN_DAY
        parts += [F.count(F.when(hit, 1)).alias("_own_day"), F.max(F.when(hit, F.least("n_fires", F.lit(1)))).cast("int").alias("fire_occurred")]
    return asked.join(known, ["cell_id", "date"]).groupBy(F.col("sample_cell").alias("cell_id"), "target_date").agg(*parts)


def _with_trends(samples: DataFrame) -> DataFrame:
    y1, y2, y3 = (F.col(f"year_{i}_avg_temp") for i in (1, 2, 3))
    f1, f2, f3 = (F.col(f"year_{i}_fire_occurred") for i in (1, 2, 3))
    return samples.withColumns(
        {
            # Slope of the least-squares line through (0, y1), (1, y2), (2, y3).
            "avg_temp_trend": F.when(y2.isNotNull(), (y3 - y1) / F.lit(2.0)),
            "fire_frequency": (f1 + f2 + f3) / F.lit(3.0),
            "avg_fire_size": F.lit(0.0),
        }
    )


def _zero_where_missing(keys: DataFrame, found: DataFrame) -> DataFrame:
    names = [c for c in found.columns if c not in ("cell_id", "target_date")]
    return keys.join(found.withColumn("_found", F.lit(1)), ["cell_id", "target_date"], "left").withColumns(
        {name: F.when(F.col("_found").isNull(), F.lit(0.0)).otherwise(F.col(name)) for name in names}
    ).drop("_found")


def yearly_features(
    keys: DataFrame, weather: DataFrame, days: DataFrame, dedupe_fires: bool = False
) -> DataFrame:
    """Same-cell weather within 7 days of the sample day, one, two and three years before."""
    return _with_trends(_zero_where_missing(keys, _looked_up(keys, weather, days, dedupe_fires, history=True)))


def neighbor_features(
    keys: DataFrame,
    neighbors: DataFrame,
    weather: DataFrame,
    days: DataFrame,
    dedupe_fires: bool = False,
    lag_years: int = 0,
) -> DataFrame:
    """Weather and fires of the neighbour cells on the sample day (or ``lag_years`` before it)."""
    return _zero_where_missing(keys, _looked_up(keys, weather, days, dedupe_fires, neighbors, lag_years=lag_years))


def cell_features(cells: DataFrame, cell_fire: DataFrame) -> DataFrame:
    """Features that do not depend on the day."""
    fires = cell_fire.groupBy("cell_id").agg(F.count("*").alias("n"))
    return cells.join(fires, "cell_id", "left").select(
        "cell_id",
        X.terrain_code(F.col("terrain_type")).cast("double").alias("terrain_type_encoded"),
        F.lit(100.0).alias("area_km2"),
        (F.coalesce("n", F.lit(0)) / F.lit(3.0)).alias("historical_fire_frequency"),
        F.lit(0.0).alias("elevation"),
    )


# Water samples: features that are zero, and those with another constant. All other columns stay null.
WATER_ZERO = tuple(
    c for c in C.FEATURE_COLUMNS if c.startswith("year_") or c in (
        "neighbor_avg_temp", "neighbor_max_temp", "neighbor_total_precip", "neighbor_fire_frequency",
        "historical_fire_frequency", "elevation_m",
    )
)
WATER_CONSTANT = {"is_water": 1.0, "area_km2": 100.0, "distance_to_urban_km": 50.0}


def water_samples(samples: DataFrame, cells: DataFrame) -> DataFrame:
    flagged = samples.join(cells.select("cell_id", F.col("urban_flag").cast("double").alias("urban_flag")), "cell_id")
    return flagged.select(
        "cell_id",
        "target_date",
        "terrain_type",
        F.lit(0).alias("fire_occurred"),
        *[F.lit(0.0).alias(c) for c in WATER_ZERO],
        *[F.lit(v).alias(c) for c, v in WATER_CONSTANT.items()],
        "urban_flag",
    )


def land_samples(
    samples: DataFrame,
    cells: DataFrame,
    weather: DataFrame,
    cell_fire: DataFrame,
    days: DataFrame,
    neighbors: DataFrame,
    dedupe_fires: bool = False,
    neighbor_lag_years: int = 0,
) -> DataFrame:
    """Features and label of land samples; a sample without weather on its day is left out.

    Features are computed once per distinct (cell, day), all in one look-up, and joined back, so a day drawn twice costs nothing extra.
    """
    kept = drop_leap_day(samples).select("cell_id", "target_date", "terrain_type")
    keys = kept.select("cell_id", "target_date").distinct()
    found = _looked_up(keys, weather, days, dedupe_fires, neighbors, history=True, own_day=True, lag_years=neighbor_lag_years)
    return (
        kept.join(_with_trends(found.filter(F.col("_own_day") > 0).drop("_own_day")), ["cell_id", "target_date"])
        .join(cell_features(cells, cell_fire), "cell_id")
    )


def training_samples(
    samples: DataFrame,
    cells: DataFrame,
    weather: DataFrame,
    cell_fire: DataFrame,
    days: DataFrame,
    neighbors: DataFrame,
    dedupe_fires: bool = False,
    neighbor_lag_years: int = 0,
) -> DataFrame:
    """The sample table with all columns in order; columns a terrain does not have are null."""
    on_land = land_samples(
        samples.filter(F.col("terrain_type") != "water"),
        cells, weather, cell_fire, days, neighbors, dedupe_fires, neighbor_lag_years,
    )
    on_water = water_samples(samples.filter(F.col("terrain_type") == "water"), cells)
    union = on_land.unionByName(on_water, allowMissingColumns=True)
    for name in C.SAMPLE_COLUMNS:
        if name not in union.columns:
            union = union.withColumn(name, F.lit(None).cast("double"))
    return union.select(*C.SAMPLE_COLUMNS)
