"""Scans of persisted tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from emberline.sources.sinks import CSV_OPTIONS

UNSET = "\u0001\u0002"


def read_table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """A parquet table, pruned to the wanted columns."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What ``sinks.write_csv`` wrote, value by value, line breaks within values included. An empty field is read as UNSET, which stands for
    null, so that a quoted empty text stays a text."""
    return spark.read.schema(schema).options(**CSV_OPTIONS, multiLine=True, nullValue=UNSET).csv(path)
