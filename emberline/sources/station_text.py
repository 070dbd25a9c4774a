"""Fixed-width station, inventory and daily-weather text.

``read_*`` turns a path into lines, ``parse_*`` turns lines into typed rows. A parser keeps every line and names the
first rule it breaks in ``reject``; ``emberline.operators.validate`` splits the two kinds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from emberline import config as C
from emberline.functions import exprs as X


def line_order() -> Column:
    """A number that grows along the lines of a file, however Spark cuts the file into splits and packs splits into tasks.

    The split's first byte is the whole part above 33 bits, the row's position in its task the part below; a decimal holds
    both in full. Rows of several files are told apart and ordered by the file's name first.
    """
    position = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).cast("decimal(10,0)")
    split = F.col("_metadata.file_block_start").cast("decimal(19,0)")
    return (split * F.lit(1 << 33).cast("decimal(10,0)") + position).cast("decimal(30,0)")


def read_lines(spark: SparkSession, path: str | list[str], glob: str = "*") -> DataFrame:
    """Text lines with the file they come from and their order; ``glob`` picks files of a folder by name."""
    return spark.read.option("pathGlobFilter", glob).text(path).select(
        "value", F.col("_metadata.file_path").alias("source_file"), line_order().alias("line_no")
    )


def parse_stations(
    lines: DataFrame, bounds: C.Bounds = C.SOUTHERN_CANADA, min_len: int = 80, strip: bool = True
) -> DataFrame:
    """Station metadata lines. ``min_len`` counts the stripped line (the validator's rule); pass
    ``min_len=84, strip=False`` for the collector's rule, which counts the line as it stands."""
    line = F.col("value")
    length = F.length(F.trim(line)) if strip else F.length(line)
    elevation_text = X.fixed_field(line, 31, 37)
    readable = (
        X.to_number(X.fixed_field(line, 12, 20)).isNotNull()
        & X.to_number(X.fixed_field(line, 21, 30)).isNotNull()
        & X.to_number(elevation_text).isNotNull()
    )
    out = lines.select(
        *[c for c in lines.columns if c != "value"],
        X.fixed_field(line, 0, 11).alias("station_id"),
        X.to_number(X.fixed_field(line, 12, 20)).alias("latitude"),
        X.to_number(X.fixed_field(line, 21, 30)).alias("longitude"),
        X.elevation_m(elevation_text).alias("elevation"),
        X.fixed_field(line, 41, 71).alias("name"),
        F.substring(line, 1, 2).alias("country"),
        (length >= min_len).alias("_long_enough"),
        readable.alias("_readable"),
    )
    reject = F.coalesce(
        F.when(~X.holds(F.col("_long_enough")), "short"),
        F.when(~F.col("_readable"), "format"),
        F.when(~X.in_bounds("latitude", "longitude", bounds), "bounds"),
    )
    return out.withColumn("reject", reject).drop("_long_enough", "_readable")


def parse_inventory(
    lines: DataFrame,
    bounds: C.Bounds = C.SOUTHERN_CANADA,
    first_year: int = C.YEAR_FIRST,
    last_year: int = C.YEAR_LAST,
    min_len: int = 45,
) -> DataFrame:
    """Station inventory lines: which element a station reports, and in which years.

    The last field ends at column 45, hence the default length; ``min_len=80`` gives the stricter historic rule under
    which lines of that layout all vanish.
    """
    line = F.col("value")
    out = lines.select(
        *[c for c in lines.columns if c != "value"],
        X.fixed_field(line, 0, 11).alias("station_id"),
        X.fixed_field(line, 31, 35).alias("parameter"),
        X.to_integer(X.fixed_field(line, 36, 40)).alias("start_year"),
        X.to_integer(X.fixed_field(line, 41, 45)).alias("end_year"),
        X.to_number(X.fixed_field(line, 12, 20)).alias("latitude"),
        X.to_number(X.fixed_field(line, 21, 30)).alias("longitude"),
        (F.length(F.trim(line)) >= min_len).alias("_long_enough"),
    )
    numbers = [F.col(c).isNull() for c in ("latitude", "longitude", "start_year", "end_year")]
    reject = F.coalesce(
        F.when(~X.holds(F.col("_long_enough")), "short"),
        F.when(numbers[0] | numbers[1] | numbers[2] | numbers[3], "format"),
        F.when(~X.in_bounds("latitude", "longitude", bounds), "bounds"),
        F.when((F.col("end_year") < first_year) | (F.col("start_year") > last_year), "years"),
        F.when(~F.col("parameter").isin(*C.ELEMENTS), "element"),
    )
    return out.withColumn("reject", reject).drop("_long_enough")


def filter_daily_years(lines: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Daily lines of the year range, kept byte for byte."""
    year = X.to_integer(F.substring("value", 12, 4))
    return lines.filter((F.length("value") >= 15) & year.between(first_year, last_year))


def daily_year_counts(lines: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Lines per year over all files, with a mark on years outside the range."""
    year = X.to_integer(F.substring("value", 12, 4))
    return (
        lines.filter((F.length("value") >= 15) & year.isNotNull())
        .groupBy(year.alias("year"))
        .agg(F.count("*").alias("n_records"))
        .withColumn("out_of_range", (~F.col("year").between(first_year, last_year)).cast("int"))
    )


def parse_daily(
    lines: DataFrame,
    mode: str = "tokens",
    first_year: int = C.YEAR_FIRST,
    last_year: int = C.YEAR_LAST,
) -> DataFrame:
    """Month lines to one row per complete reading: station_id, date, element, value, quality, line_no.

    ``tokens`` splits the data part on blanks and reads (value, flag) pairs, so a value without a flag shifts the later
    days: the historic result. ``fixed`` reads 31 groups of eight characters (value and three flags) and keeps those
    whose quality flag is blank and whose source flag is the complete mark.
    """
    line = F.col("value")
    head = lines.select(
        *[c for c in lines.columns if c != "value"],
        X.fixed_field(line, 0, 11).alias("station_id"),
        X.to_integer(F.substring(line, 12, 4)).alias("year"),
        X.to_integer(F.substring(line, 16, 2)).alias("month"),
        X.fixed_field(line, 17, 21).alias("element"),
        F.substring(line, 22, F.length(line)).alias("tail"),
        F.length(line).alias("_length"),
    ).filter(
        (F.col("_length") >= 34)
        & F.col("element").isin(*C.ELEMENTS)
        & F.col("year").between(first_year, last_year)
        & F.col("month").between(1, 12)
    )
    month_days = X.days_in_month(F.col("year"), F.col("month"))
    if mode == "tokens":
        head = head.withColumn("_tokens", F.split(F.trim("tail"), r"\s+"))
        pairs = (F.size("_tokens") / F.lit(2)).cast("int")
        last = F.least(month_days, pairs)

        def reading(day):
            return F.struct(
                day.alias("day"), F.col("_tokens")[day * 2 - 2].alias("raw"), F.col("_tokens")[day * 2 - 1].alias("quality")
            )

        def complete(r):
            return r["quality"] == C.COMPLETE_FLAG
    elif mode == "fixed":
        last = F.least(month_days, F.ceil(F.length("tail") / F.lit(8)).cast("int"))

        def reading(day):
            start = (day - 1) * 8 + 1
            return F.struct(
                day.alias("day"),
                F.substring("tail", start, F.lit(5)).alias("raw"),
                F.substring("tail", start + 7, F.lit(1)).alias("quality"),
                F.substring("tail", start + 6, F.lit(1)).alias("quality_flag"),
            )

        def complete(r):
            return (r["quality"] == C.COMPLETE_FLAG) & (r["quality_flag"].isin("", " "))
    else:
        raise ValueError(f"unknown daily parse mode: {mode}")

    # Everything happens inside the array of the line: only accepted readings become rows, and no filter above has to
    # evaluate a value again.
    element = F.col("element")
    complete_days = F.filter(F.transform(F.sequence(F.lit(1), last), reading), complete)
    values = F.transform(
        complete_days,
        lambda r: F.struct(r["day"].alias("day"), X.clean_reading(element, r["raw"]).alias("value"), r["quality"].alias("quality")),
    )
    accepted = F.filter(values, lambda r: X.reading_in_range(element, r["value"]))
    keys = [c for c in ("source_file", "line_no") if c in lines.columns]
    return head.select(
        *keys, "station_id", "year", "month", "element", F.explode(F.when(last >= 1, accepted)).alias("r")
    ).select(
        *keys,
        "station_id",
        F.make_date("year", "month", F.col("r.day")).alias("date"),
        "element",
        F.col("r.value").alias("value"),
        F.col("r.quality").alias("quality"),
    )
