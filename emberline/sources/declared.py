"""Stored tables with a declared schema: types, required values and keys are checked at the write.

A write goes to a folder of its own. Only when the stored rows pass the checks does a row in the table's list of commits name that folder,
so readers see the old rows or the new ones, never a mixture, and a write that fails or is rejected leaves the old table as it was. Nothing is
renamed, which object stores do by copying. One writer at a time per table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from emberline.session import drop_path, path_exists
from emberline.sources.sinks import write_table

COMMITS = "seq long, version string, n_rows long, written timestamp"


class DeclarationError(ValueError):
    """Rows that do not fit the declaration of their table."""


@dataclass(frozen=True)
class Declared:
    """``columns``: DDL, with NOT NULL where a value is required. ``key``: columns that no two rows share all values of, and that are never null."""

    columns: str
    key: tuple[str, ...] = ()

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.columns)

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.schema if not f.nullable or f.name in self.key]

    def stored_schema(self) -> StructType:
        """The schema that files are read by; they hold nullable columns, whatever was declared."""
        return StructType([StructField(f.name, f.dataType) for f in self.schema])


STATIONS = Declared(
    "station_id string, latitude double NOT NULL, longitude double NOT NULL, elevation double, name string, country string", ("station_id",)
)
STATION_NEIGHBORS = Declared(
    "station_id string NOT NULL, neighbor_id string NOT NULL, distance_km double NOT NULL, rank int NOT NULL", ("station_id", "rank")
)
WEATHER_WIDE = Declared(
    "station_id string, date date, tmax double, tmin double, tavg double, prcp double, snwd double, tmax_quality string, tmin_quality string,"
    " tavg_quality string, prcp_quality string, snwd_quality string, temp_range double, year int, month int, day_of_year int, season string,"
    " data_completeness double",
    ("station_id", "date"),
)
GRID_CELLS = Declared(
    "cell_id long, center_lat double NOT NULL, center_lon double NOT NULL, terrain_type string NOT NULL, is_water int, urban_flag int", ("cell_id",)
)
CELL_STATION = Declared(
    "cell_id long, station_id string NOT NULL, dist_km double NOT NULL, rnk int, primary_station string NOT NULL, primary_distance double NOT NULL",
    ("cell_id", "rnk"),
)
FIRE_EVENTS = Declared(
    "fire_id string, center_cell_id long, start_date date, end_date date, total_size_ha double, fire_type string, latitude double,"
    " longitude double, affected_cells string",
    ("fire_id",),
)
CELL_FIRE = Declared(
    "cell_id long, fire_id string, fire_size_ha double, fire_start_date date, fire_end_date date", ("cell_id", "fire_id")
)


def conforming(df: DataFrame, table: Declared) -> DataFrame:
    """The declared columns of ``df`` in their order. Missing or further columns and other types are errors, which need no job to find."""
    wanted = {f.name: f.dataType.simpleString() for f in table.schema}
    given = dict(df.dtypes)
    faults = [f"no column {c}" for c in wanted if c not in given] + [f"undeclared column {c}" for c in given if c not in wanted]
    faults += [f"{c} is {given[c]}, declared {t}" for c, t in wanted.items() if given.get(c, t) != t]
    if faults:
        raise DeclarationError("; ".join(faults))
    return df.select(*wanted)


def report(df: DataFrame, table: Declared) -> DataFrame:
    """One row: n_rows, n_nulls (required values that are missing), n_repeats (rows beyond the first of their key)."""
    missing = sum((F.col(c).isNull().cast("long") for c in table.required), F.lit(0).cast("long"))
    # Counted per key, with map-side combine: a key that holds many rows is no hot task.
    if table.key:
        counted = df.groupBy(*table.key).agg(F.count("*").alias("n"), F.sum(missing).alias("missing"))
    else:
        counted = df.select(F.lit(1).alias("n"), missing.alias("missing"))
    none = F.lit(0).cast("long")
    return counted.agg(
        F.coalesce(F.sum("n"), none).alias("n_rows"), F.coalesce(F.sum("missing"), none).alias("n_nulls"),
        F.coalesce(F.sum(F.col("n") - 1), none).cast("long").alias("n_repeats"),
    )


def commits(spark: SparkSession, root: str) -> DataFrame | None:
    """The commits of the table in ``root``, or None where none was made."""
    path = f"{root}/commits"
    return spark.read.schema(COMMITS).parquet(path) if path_exists(spark, path) else None


def last_commits(spark: SparkSession, root: str) -> list:
    """The last commit and the two before it, newest first."""
    made = commits(spark, root)
    return [] if made is None else made.orderBy(F.desc("seq"), "version").limit(3).collect()


def write_declared(df: DataFrame, root: str, table: Declared, write: Callable[[DataFrame, str], None] = write_table) -> DataFrame:
    """Write ``df`` as the new rows of the table in ``root``, check what was stored, commit, and give back the stored rows.

    ``write`` lays the files out. The rows before these stay for readers under way; older ones are deleted.
    """
    spark = df.sparkSession
    version = uuid.uuid4().hex
    path = f"{root}/versions/{version}"
    try:
        write(conforming(df, table), path)
        stored = spark.read.schema(table.stored_schema()).parquet(path)
        found = report(stored, table).first()
        if found.n_nulls or found.n_repeats:
            raise DeclarationError(f"{found.n_nulls} required values are missing, {found.n_repeats} rows repeat a key")
    except Exception:
        drop_path(spark, path)
        raise
    before = last_commits(spark, root)
    row = spark.range(1).select(
        F.lit(before[0].seq + 1 if before else 1).cast("long").alias("seq"), F.lit(version).alias("version"),
        F.lit(found.n_rows).cast("long").alias("n_rows"), F.current_timestamp().alias("written"),
    )
    row.coalesce(1).write.mode("append").parquet(f"{root}/commits")
    for old in before[1:]:
        drop_path(spark, f"{root}/versions/{old.version}")
    return stored


def read_declared(spark: SparkSession, root: str, table: Declared, *columns: str) -> DataFrame:
    """The committed rows of the table in ``root``, pruned to the wanted columns."""
    last = last_commits(spark, root)
    if not last:
        raise FileNotFoundError(f"no committed table in {root}")
    df = spark.read.schema(table.stored_schema()).parquet(f"{root}/versions/{last[0].version}")
    return df.select(*columns) if columns else df
