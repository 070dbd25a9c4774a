"""Counts, ranges, quality checks and summaries of the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from emberline import config as C


def _stack(one_row: DataFrame, names: list[str], parts: list[str], key: str) -> DataFrame:
    """Turn one wide row with columns ``<part>__<i>`` into one row per name, without another pass over the data."""
    structs = [
        F.struct(F.lit(name).alias(key), *[F.col(f"{part}__{i}").alias(part) for part in parts])
        for i, name in enumerate(names)
    ]
    return one_row.select(F.inline(F.array(*structs)))


def non_null_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Non-null and null values per column, in one pass."""
    names = list(columns or df.columns)
    aggs = []
    for i, c in enumerate(names):
        aggs += [F.count(c).alias(f"non_null__{i}"), F.count(F.when(F.col(c).isNull(), 1)).alias(f"nulls__{i}")]
    return _stack(df.agg(*aggs), names, ["non_null", "nulls"], "column_name")


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Rows per value of each column, one pass over the input; null counts as a value of its own."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    )
    return (
        df.select(pairs.alias("p"))
        .groupBy("p.column_name", "p.value")
        .agg(F.count("*").alias("n"))
    )


def range_profile(df: DataFrame, *columns: str) -> DataFrame:
    """Least and greatest value of each column, as doubles."""
    names = list(columns)
    aggs = []
    for i, c in enumerate(names):
        aggs += [F.min(c).cast("double").alias(f"low__{i}"), F.max(c).cast("double").alias(f"high__{i}")]
    return _stack(df.agg(*aggs), names, ["low", "high"], "column_name")


def feature_profile(df: DataFrame, *columns: str) -> DataFrame:
    """Mean, sample deviation, nulls and constancy per numeric column, in one pass.

    A column is constant when it has at most one distinct value, that is when its least and greatest value agree; no
    distinct count is needed.
    """
    names = list(columns)
    aggs = []
    for i, c in enumerate(names):
        v = F.col(c).cast("double")
        aggs += [
            F.avg(v).alias(f"mean__{i}"),
            F.stddev_samp(v).alias(f"std__{i}"),
            F.count(F.when(v.isNull(), 1)).alias(f"nulls__{i}"),
            F.coalesce(F.min(v) == F.max(v), F.lit(True)).cast("int").alias(f"constant__{i}"),
        ]
    return _stack(df.agg(*aggs), names, ["mean", "std", "nulls", "constant"], "feature")


def class_balance(df: DataFrame, label: str = "fire_occurred", cap: float = 5.0) -> DataFrame:
    """Positives, rate, a warning below 5 % or above 50 %, and the capped weight of a positive row."""
    y = F.col(label)
    rate = F.col("positives") / F.col("total")
    ratio = F.try_divide(F.col("total") - F.col("positives"), F.col("positives"))
    return (
        df.agg(F.count("*").alias("total"), F.count(F.when(y > 0, 1)).alias("positives"))
        .withColumns(
            {
                "negatives": F.col("total") - F.col("positives"),
                "fire_rate": F.try_divide(F.col("positives"), F.col("total")),
                "balance": F.when(rate < 0.05, "low").when(rate > 0.5, "high").otherwise("ok"),
                "positive_weight": F.when(F.col("positives") > 0, F.least(ratio, F.lit(cap))).otherwise(F.lit(1.0)),
            }
        )
    )


def terrain_counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy("terrain_type").agg(F.count("*").alias("n_cells"), F.sum("is_water").alias("n_water_flag"))


def weather_summary(assignments: DataFrame, days: DataFrame) -> DataFrame:
    """Rows, cells, days and the first and last day of the cell weather: every assigned cell has every reported day, so its rows
    need not be made to be counted."""
    cells = assignments.filter(F.col("rnk") == 1).agg(F.count("*")).scalar()
    return days.agg(
        F.count_distinct("date").alias("n_dates"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    ).select((cells * F.col("n_dates")).alias("n_rows"), cells.alias("n_cells"), "n_dates", "first_date", "last_date")


def distinct_dates(weather: DataFrame) -> DataFrame:
    return weather.select("date").distinct().orderBy("date")


def fire_summary(events: DataFrame, cell_fire: DataFrame) -> DataFrame:
    """Events and burned area, relations and cells touched, in one row."""
    relations = cell_fire.agg(
        F.struct(F.count("*").alias("n_relations"), F.count_distinct("cell_id").alias("n_cells"))
    ).scalar()
    return events.agg(F.count("*").alias("n_events"), F.sum("total_size_ha").alias("total_ha")).select(
        "n_events", "total_ha", relations["n_relations"].alias("n_relations"), relations["n_cells"].alias("n_cells")
    )


def pool_summary(samples: DataFrame) -> DataFrame:
    """Rows, fires, rate, share and day range per terrain, and over all."""
    rows = samples.groupBy("terrain_type").agg(
        F.count("*").alias("n_rows"),
        F.sum("fire_occurred").alias("n_fires"),
        F.min("target_date").alias("first_date"),
        F.max("target_date").alias("last_date"),
    )
    total = rows.agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_fires").alias("n_fires"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
    ).withColumn("terrain_type", F.lit("all"))
    both = rows.unionByName(total)
    # At most five rows by now.
    over = Window.partitionBy(F.lit(1))
    return both.withColumns(
        {
            "fire_rate": F.col("n_fires") / F.col("n_rows"),
            "terrain_share": F.col("n_rows") / F.max("n_rows").over(over),
        }
    )


def dataset_metadata(train: DataFrame, test: DataFrame) -> DataFrame:
    """One JSON document: sample counts, feature list, terrain and label distributions. Only per-value counts are
    gathered, never rows."""
    def spread(df, column):
        counts = df.groupBy(F.col(column).cast("string").alias("k")).agg(F.count("*").alias("n"))
        return counts.agg(
            F.sort_array(F.collect_list(F.struct("k", "n"))).alias("entries"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")
        )

    terrain = spread(train, "terrain_type").select(F.struct("entries", "total")).scalar()
    label = spread(train, "fire_occurred").select("entries").scalar()
    doc = F.struct(
        terrain["total"].alias("training_samples"),
        F.col("n_test").alias("test_samples"),
        F.array(*[F.lit(c) for c in train.columns]).alias("features"),
        F.map_from_entries(terrain["entries"]).alias("terrain_distribution"),
        F.map_from_entries(label).alias("fire_distribution"),
    )
    return test.agg(F.count("*").alias("n_test")).select(F.to_json(doc).alias("metadata"))


def upsert_metadata(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Key / value metadata with the last write of each key kept; both inputs have key, value, description, written."""
    last = F.max_by(F.struct("value", "description"), F.col("written"))
    return (
        current.unionByName(updates)
        .groupBy("key")
        .agg(last.alias("v"), F.max("written").alias("written"))
        .select("key", "v.value", "v.description", "written")
    )


def table_counts(tables: dict[str, tuple[DataFrame, str]], written: int = 0) -> DataFrame:
    """Row count of each table as metadata rows."""
    parts = [
        df.agg(F.count("*").alias("n")).select(
            F.lit(f"{name}_count").alias("key"),
            F.col("n").cast("string").alias("value"),
            F.lit(text).alias("description"),
            F.lit(written).alias("written"),
        )
        for name, (df, text) in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)
