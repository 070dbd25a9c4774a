"""Station weather: last reading wins, long to wide, calendar features."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from emberline import config as C
from emberline.functions import exprs as X

MEASURES = tuple(e.lower() for e in C.ELEMENTS)


def accept_readings(readings: DataFrame) -> DataFrame:
    """Complete readings in range, in the units given (text readings are cleaned by the parser already)."""
    return readings.filter(
        F.col("value").isNotNull()
        & (F.col("quality") == C.COMPLETE_FLAG)
        & F.col("element").isin(*C.ELEMENTS)
        & X.reading_in_range(F.col("element"), F.col("value"))
    )


def weather_wide(readings: DataFrame) -> DataFrame:
    """One row per station and day from accepted readings (station_id, date, element, value, quality, line_no).

    A later line overwrites an earlier one; of several files (``source_file``) the later by name comes last. The pivot and the last-wins choice are a single hash aggregation over
    fixed-width buffers, combined before the shuffle, so a day repeated any number of times costs one row per task.
    Accepted readings all carry the complete flag, so the flag column follows from the value.
    """
    order = F.struct("source_file", "line_no") if "source_file" in readings.columns else F.col("line_no")

    def last(element):
        hit = F.col("element") == element
        return F.max_by(F.when(hit, F.col("value")), F.when(hit, order))

    wide = readings.groupBy("station_id", "date").agg(*[last(e).alias(e.lower()) for e in C.ELEMENTS])
    flags = {f"{m}_quality": F.when(F.col(m).isNotNull(), C.COMPLETE_FLAG) for m in MEASURES}
    return wide.withColumns(flags)


def enrich(wide: DataFrame) -> DataFrame:
    """Temperature range, calendar parts, season and the share of measures present."""
    full = wide
    for m in MEASURES:
        if m not in full.columns:
            full = full.withColumn(m, F.lit(None).cast("double"))
        if f"{m}_quality" not in full.columns:
            full = full.withColumn(f"{m}_quality", F.lit(None).cast("string"))
    return full.withColumns(
        {
            "temp_range": F.col("tmax") - F.col("tmin"),
            "year": F.year("date"),
            "month": F.month("date"),
            "day_of_year": F.dayofyear("date"),
            "season": X.season(F.month("date")),
            "data_completeness": X.completeness(*MEASURES),
        }
    )


def match_stations(lines: DataFrame, stations: DataFrame, bounds: C.Bounds = C.SOUTHERN_CANADA) -> tuple[DataFrame, DataFrame]:
    """Daily lines of known Canadian stations inside the box, and the station ids that have no metadata.

    Stations are unique by id, so a station that holds a large share of the lines is a skewed join key on one side only,
    which adaptive execution splits (or avoids, when the station list is small enough to broadcast at run time).
    """
    keyed = lines.withColumn("station_id", X.fixed_field("value", 0, 11)).filter(F.col("station_id").startswith("CA"))
    inside = stations.filter(X.in_bounds("latitude", "longitude", bounds)).select("station_id")
    kept = keyed.join(inside, "station_id", "left_semi")
    unknown = keyed.select("station_id").distinct().join(stations.select("station_id"), "station_id", "left_anti")
    return kept, unknown
