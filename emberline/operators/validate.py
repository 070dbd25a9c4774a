"""Validation: ordered reject rules, the valid / rejected split and the report over it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from emberline import config as C
from emberline.functions import exprs as X


def first_failing(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule whose failing condition is true; null when every rule passes."""
    return F.coalesce(*[F.when(failing, F.lit(name)) for name, failing in rules])


def valid(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("reject").isNull()).drop("reject")


def rejected(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("reject").isNotNull())


def with_columns(df: DataFrame, names: tuple[str, ...], default: Column | None = None) -> DataFrame:
    """Add the missing ones of ``names``, as null or as ``default``."""
    missing = [n for n in names if n not in df.columns]
    blank = F.lit(None).cast("string") if default is None else default
    return df.withColumns({n: blank for n in missing}) if missing else df


def drop_sentinel_fires(raw: DataFrame) -> DataFrame:
    """Collector rule: no year, month or day of 0 or -9999; point reports also need both coordinates."""
    kinds = dict(raw.dtypes)

    def number(name):
        return X.to_number(F.col(name)) if kinds[name] == "string" else F.col(name)

    keep = reduce(
        lambda a, b: a & b,
        [~X.holds(number(part).isin(*C.DATE_SENTINELS)) for part in ("YEAR", "MONTH", "DAY")],
    )
    if "LATITUDE" in raw.columns and "LONGITUDE" in raw.columns:
        keep = keep & F.col("LATITUDE").isNotNull() & F.col("LONGITUDE").isNotNull()
    return raw.filter(keep)


def classify_fires(
    raw: DataFrame,
    bounds: C.Bounds = C.SOUTHERN_CANADA,
    first_year: int = C.YEAR_FIRST,
    last_year: int = C.YEAR_LAST,
) -> DataFrame:
    """Typed fire reports with the first broken rule in ``reject``.

    Input columns may be text or numbers. A number that cannot be read breaks the ``format`` rule; a missing coordinate
    breaks ``bounds``; a missing size counts as zero; a missing geometry is accepted.
    """
    df = with_columns(raw, C.FIRE_TEXT_COLUMNS, F.lit(""))
    df = with_columns(df, ("geometry_wkt",), F.lit(""))

    kinds = dict(df.dtypes)

    def text(name):
        return F.col(name).cast("string")

    def number(name):
        return X.to_number(F.col(name)) if kinds[name] == "string" else F.col(name).cast("double")

    def unreadable(name):
        if kinds[name] != "string":
            return F.lit(False)
        return F.col(name).isNotNull() & (F.trim(F.col(name)) != "") & number(name).isNull()

    def whole(name):
        if kinds[name] == "int":
            return F.col(name)
        return F.when(F.abs(number(name)) < 2e9, F.floor(number(name))).cast("int")

    carried = [c for c in ("source_file", "line_no") if c in df.columns]
    typed = df.select(
        *carried,
        *[F.coalesce(text(c), F.lit("")).alias(c) for c in C.FIRE_TEXT_COLUMNS],
        number("LATITUDE").alias("LATITUDE"),
        number("LONGITUDE").alias("LONGITUDE"),
        whole("YEAR").alias("YEAR"),
        whole("MONTH").alias("MONTH"),
        whole("DAY").alias("DAY"),
        F.coalesce(number("SIZE_HA"), F.lit(0.0)).alias("SIZE_HA"),
        text("geometry_wkt").alias("geometry_wkt"),
        (unreadable("LATITUDE") | unreadable("LONGITUDE")).alias("_bad_place"),
        unreadable("SIZE_HA").alias("_bad_size"),
    )
    year, month, day = F.col("YEAR"), F.col("MONTH"), F.col("DAY")
    fire_date = F.when(
        year.between(first_year, last_year) & month.between(1, 12) & day.between(1, 31), X.valid_day(year, month, day)
    )
    typed = typed.withColumn("fire_date", fire_date)
    reject = first_failing(
        [
            ("format", F.col("_bad_place")),
            ("bounds", ~X.holds(X.in_bounds("LATITUDE", "LONGITUDE", bounds))),
            ("format", year.isNull() | month.isNull() | day.isNull()),
            ("year", ~year.between(first_year, last_year)),
            ("month", ~month.between(1, 12)),
            ("day", ~day.between(1, 31)),
            ("date", F.col("fire_date").isNull()),
            ("format", F.col("_bad_size")),
            ("size", ~F.col("SIZE_HA").between(*C.FIRE_SIZE_RANGE_HA)),
            ("geometry", ~X.wkt_known("geometry_wkt")),
        ]
    )
    return typed.withColumn("reject", reject).drop("_bad_place", "_bad_size")


def rule_counts(classified: dict[str, DataFrame]) -> DataFrame:
    """Rows per table and rule; the rule of accepted rows is ``valid``."""
    parts = [
        df.select(F.lit(name).alias("table_name"), F.coalesce("reject", F.lit("valid")).alias("rule"))
        .groupBy("table_name", "rule")
        .agg(F.count("*").alias("n"))
        for name, df in classified.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def processed_counts(classified: dict[str, DataFrame]) -> DataFrame:
    """Rows processed, valid and removed per table; processed counts the real input rows."""
    parts = [
        df.agg(
            F.count("*").alias("processed"),
            F.count(F.when(F.col("reject").isNull(), 1)).alias("valid"),
            F.count("reject").alias("removed"),
        ).select(F.lit(name).alias("table_name"), "processed", "valid", "removed")
        for name, df in classified.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def reject_rows(classified: DataFrame, table_name: str, *detail: str) -> DataFrame:
    """The rejected rows themselves, for the report: table, file and line where known, rule and chosen columns."""
    keep = [c for c in ("source_file", "line_no") if c in classified.columns]
    return rejected(classified).select(F.lit(table_name).alias("table_name"), *keep, "reject", *detail)
