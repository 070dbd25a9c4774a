"""Writers: CSV with header, parquet tables laid out for the later scans, JSON summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


# Quotes inside a value are doubled, as other CSV readers expect; blanks at the ends of a value are part of it.
CSV_OPTIONS = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; an empty table still gets its header line, since Spark writes one part for it. A null is an empty field, an
    empty text is a quoted one, and values with quotes, commas or line breaks are quoted."""
    df.write.mode(mode).options(**CSV_OPTIONS).csv(path)


def write_daily_text(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Pass-through of daily lines, one folder per station.

    The rebalance hint gathers a station's lines for few files, and lets adaptive execution cut a station that holds a large
    share of all lines into tasks of the advisory size.
    """
    station = F.trim(F.substring("value", 1, 11))
    order = [c for c in ("source_file", "line_no") if c in lines.columns]
    (
        lines.select("value", station.alias("station_id"), *order)
        .hint("rebalance", F.col("station_id"))
        .sortWithinPartitions("station_id", *order)
        .drop(*order)
        .write.mode(mode)
        .partitionBy("station_id")
        .text(path)
    )


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_weather(df: DataFrame, path: str, key: str = "cell_id", mode: str = "overwrite") -> None:
    """Weather tables: one folder per year (dates prune folders), rows sorted by key and day inside the files.

    Rows are rebalanced by year and block of keys: neighbouring cells share files, so row-group statistics serve look-ups by
    cell, and adaptive execution joins small blocks and cuts large ones to the advisory size, whatever the table's size.
    """
    is_text = dict(df.dtypes)[key] == "string"
    block = F.pmod(F.xxhash64(key), F.lit(1024)) if is_text else F.floor(F.col(key) / F.lit(1000))
    (
        df.withColumn("_block", block)
        .hint("rebalance", F.col("year"), F.col("_block"))
        .drop("_block")
        .sortWithinPartitions("year", key, "date")
        .write.mode(mode)
        .partitionBy("year")
        .parquet(path)
    )


def write_fire_events(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Fire events with the cell list as JSON text."""
    write_table(with_json_cells(df), path, mode)


def with_json_cells(events: DataFrame) -> DataFrame:
    return events.withColumn("affected_cells", F.to_json("affected_cells"))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A small summary as one JSON file."""
    df.coalesce(1).write.mode(mode).json(path)
