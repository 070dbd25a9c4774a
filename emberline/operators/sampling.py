"""Cell targets, sample dates and splits, all by repeatable md5 ranks.

Where a quota is a small parameter, the rank is cut at the largest quota, a constant: Spark then limits each group inside every
task before the shuffle (it does so up to a limit of 1,000). Larger quotas are cut by rank prefixes first (``lowest_ranks``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from emberline import config as C
from emberline.functions import exprs as X


def by_name(name: Column, values: dict[str, float]) -> Column:
    """A constant looked up by name; null for other names."""
    return reduce(lambda chain, kv: chain.when(name == kv[0], F.lit(kv[1])), values.items(), F)


def cell_stats(cells: DataFrame, days: DataFrame, cell_fire: DataFrame) -> DataFrame:
    """Per cell: mean confidence, days with data and number of fires. ``days``: cell_id, avg_confidence, data_days. Fires are
    folded to one row per cell before they meet, so days and fires of a cell never multiply."""
    fires = cell_fire.groupBy("cell_id").agg(F.count_distinct("fire_id").alias("fire_count"))
    return (
        cells.join(days, "cell_id", "left")
        .join(fires, "cell_id", "left")
        .withColumns(
            {"data_days": F.coalesce("data_days", F.lit(0)).cast("long"), "fire_count": F.coalesce("fire_count", F.lit(0))}
        )
    )


def no_fire_cells(cells: DataFrame, cell_fire: DataFrame) -> DataFrame:
    return cells.filter(F.col("terrain_type").isin(*C.LAND_TERRAINS)).join(
        cell_fire.select("cell_id"), "cell_id", "left_anti"
    )


def target_cells(
    stats: DataFrame,
    targets: int = C.TARGET_CELLS,
    share: dict[str, float] | None = None,
    confidence_min: dict[str, float] | None = None,
    min_days: int = C.MIN_DAYS_TARGET,
    water_cells: int = C.WATER_CELLS,
) -> DataFrame:
    """Balanced, terrain-stratified target cells.

    Per terrain the quota is ``int(targets * share)``; up to half are cells with fires, the rest cells without. Land
    cells need enough days and confidence; water cells are the first ones by id, whatever their weather.
    """
    share = share or C.TERRAIN_SHARE
    confidence_min = confidence_min or C.CONFIDENCE_MIN
    quota = {name: int(targets * part) for name, part in share.items()}
    terrain, burned = F.col("terrain_type"), F.col("fire_count") > 0
    confident = X.holds(F.round("avg_confidence", 9) >= by_name(terrain, confidence_min))
    enough = (F.col("data_days") >= min_days) & confident
    dry_water = (terrain == "water") & ~burned
    # One pass over the cells: each candidate belongs to one stratum, and each stratum is cut to a constant number of
    # rows (water by id, others by md5 rank), inside every task before the shuffle.
    candidates = (
        stats.filter(terrain.isin(*share))
        .filter(dry_water | (enough & (burned | terrain.isin(*C.LAND_TERRAINS))))
        .withColumns(
            {
                "_burned": burned,
                "_dry_water": dry_water,
                "_id_first": F.when(dry_water, F.col("cell_id")),
                "_rank": X.sampling_rank("cell_id"),
            }
        )
    )
    first_cut = Window.partitionBy("terrain_type", "_burned").orderBy("_id_first", "_rank", "cell_id")
    largest = max(quota.values())
    kept = (
        candidates.withColumn("_n", F.row_number().over(first_cut))
        .filter(F.col("_n") <= max(largest, water_cells))
        .filter(F.col("_n") <= F.when(F.col("_dry_water"), water_cells).otherwise(largest))
    )
    # From here on at most two strata of a few hundred rows per terrain remain.
    at_random = Window.partitionBy("terrain_type", "_burned").orderBy("_rank", "cell_id")
    in_terrain = Window.partitionBy("terrain_type")
    n = by_name(terrain, quota)
    n_fire = F.least(F.floor(n / 2), F.count(F.when(F.col("_burned"), 1)).over(in_terrain))
    chosen = (
        kept.withColumns(
            {"_n": F.row_number().over(at_random), "_quota": F.when(F.col("_burned"), n_fire).otherwise(n - n_fire)}
        )
        .filter(F.col("_n") <= F.col("_quota"))
    )
    none = F.lit(0).cast("long")
    return chosen.withColumns(
        {
            "avg_confidence": F.when(F.col("_dry_water"), 0.0).otherwise(F.col("avg_confidence")),
            "data_days": F.when(F.col("_dry_water"), none).otherwise(F.col("data_days")),
        }
    ).drop("_burned", "_dry_water", "_id_first", "_rank", "_n", "_quota")


def pool_cells(
    stats: DataFrame,
    size: int = C.POOL_SIZE,
    share: dict[str, float] | None = None,
    min_days: int = C.MIN_DAYS_POOL,
) -> DataFrame:
    """Cells of the test pool by terrain quota, all of a terrain that has too few."""
    quota = {name: int(size * part) for name, part in (share or C.POOL_SHARE).items()}
    asked = stats.filter((F.col("data_days") >= min_days) & F.col("terrain_type").isin(*quota)).withColumn(
        "_rank", X.sampling_rank("cell_id")
    )
    return lowest_ranks(asked, "terrain_type", by_name(F.col("terrain_type"), quota), "cell_id").drop("_rank")


def lowest_ranks(rows: DataFrame, group: str, quota: Column, *ties: str) -> DataFrame:
    """Of each group the ``quota`` rows with the lowest md5 text ``_rank``.

    Rows are counted per group and four-digit prefix of the rank (at most 65,536 a group); only prefixes up to the one in which the
    quota is reached go to the shuffle, so a group's task gets its quota and some rows more, whatever the quota and the group.
    """
    keyed = rows.withColumn("_prefix", F.substring("_rank", 1, 4))
    below = Window.partitionBy(group).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy(group, "_prefix").agg(F.count("*").alias("_n"))
    cuts = (
        counts.withColumn("_before", F.coalesce(F.sum("_n").over(below), F.lit(0)))
        .filter(F.col("_before") < quota)
        .groupBy(F.col(group).alias("_group"))
        .agg(F.max("_prefix").alias("_cut"))
    )
    order = Window.partitionBy(group).orderBy("_rank", *ties)
    return (
        keyed.join(cuts, (F.col(group) == F.col("_group")) & (F.col("_prefix") <= F.col("_cut")))
        .withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= quota)
        .drop("_group", "_cut", "_prefix", "_n")
    )


def random_order(df: DataFrame, *key: str, seed: int = C.SAMPLE_SEED) -> DataFrame:
    """Rows in a repeatable random order (a range-partitioned sort)."""
    return df.orderBy(X.sampling_rank(*key, seed=seed), *key)


def random_subset(df: DataFrame, n: int, *key: str, seed: int = C.SAMPLE_SEED) -> DataFrame:
    """``n`` rows at random, all when there are fewer; a top-k, so each task passes on at most ``n`` rows."""
    return random_order(df, *key, seed=seed).limit(n)


def sample_dates(
    targets: DataFrame,
    weather: DataFrame,
    cell_fire: DataFrame,
    kind: str,
    temporal_split: bool = False,
) -> DataFrame:
    """Sample days of every target cell: (cell_id, terrain_type, target_date, draw).

    Land cells take up to half of their days from burning days (in order of interval and day) and the rest at random
    from the days with weather; a day drawn both ways appears twice. Water cells all take the same random summer
    days. ``temporal_split`` keeps training and test days in their own years.
    """
    per_cell = C.DATES_PER_CELL[kind]
    if temporal_split:
        first_day, last_day = C.SPLIT_PERIOD[kind]
    else:
        first_day, last_day = f"{C.SAMPLE_YEARS[0]}-01-01", f"{C.SAMPLE_YEARS[1]}-12-31"
    lo, hi = F.lit(first_day).cast("date"), F.lit(last_day).cast("date")
    land = targets.filter(F.col("terrain_type") != "water").select("cell_id", "terrain_type", "fire_count")
    available = (
        weather.filter(F.col("date").between(lo, hi))
        .select("cell_id", "date")
        .join(land.select("cell_id"), "cell_id", "left_semi")
        .distinct()
    )
    at_random = Window.partitionBy("cell_id").orderBy(X.sampling_rank("cell_id", "date"), "date")
    drawn = available.withColumn("_n", F.row_number().over(at_random)).filter(F.col("_n") <= per_cell)
    # A cell has min(per_cell, available) drawn rows, which is its number of samples.
    wanted = drawn.groupBy("cell_id").agg(F.count("*").cast("int").alias("_samples"))

    burning = (
        cell_fire.join(land.filter(F.col("fire_count") > 0).select("cell_id"), "cell_id", "left_semi")
        .select("cell_id", "fire_start_date", "fire_end_date")
        .distinct()
        .filter((F.col("fire_start_date") <= hi) & (F.col("fire_end_date") >= lo))
        .filter(F.col("fire_start_date") <= F.col("fire_end_date"))
        .select(
            "cell_id",
            "fire_start_date",
            "fire_end_date",
            F.explode(F.sequence(F.greatest("fire_start_date", lo), F.least("fire_end_date", hi))).alias("date"),
        )
        .join(available, ["cell_id", "date"], "left_semi")
    )
    in_order = Window.partitionBy("cell_id").orderBy("fire_start_date", "fire_end_date", "date")
    first_burning = (
        burning.withColumn("_n", F.row_number().over(in_order))
        .filter(F.col("_n") <= per_cell // 2)
        .join(wanted, "cell_id")
        .filter(F.col("_n") <= F.floor(F.col("_samples") / 2))
        .select("cell_id", "date", "_n")
    )
    n_burning = first_burning.groupBy("cell_id").agg(F.count("*").alias("_burning"))
    rest = (
        drawn.join(wanted, "cell_id")
        .join(n_burning, "cell_id", "left")
        .withColumn("_burning", F.coalesce("_burning", F.lit(0)))
        .filter(F.col("_n") <= F.col("_samples") - F.col("_burning"))
        .select("cell_id", "date", (F.col("_n") + F.col("_burning")).alias("_n"))
    )
    on_land = (
        first_burning.withColumn("_n", F.col("_n").cast("long"))
        .unionByName(rest)
        .join(land.select("cell_id", "terrain_type"), "cell_id")
        .select("cell_id", "terrain_type", F.col("date").alias("target_date"), F.col("_n").cast("int").alias("draw"))
    )
    return on_land.unionByName(water_dates(targets, kind))


def water_dates(targets: DataFrame, kind: str) -> DataFrame:
    """The same random summer days for every water cell; the days are a parameter, not data."""
    first_day, last_day = (F.lit(d).cast("date") for d in C.WATER_DATES[kind])
    days = F.transform(
        F.sequence(first_day, last_day), lambda d: F.struct(X.sampling_rank(d.cast("string")).alias("k"), d.alias("d"))
    )
    chosen = F.slice(F.array_sort(days), 1, C.DATES_PER_CELL[kind])
    return (
        targets.filter(F.col("terrain_type") == "water")
        .select("cell_id", "terrain_type", F.posexplode(chosen))
        .select("cell_id", "terrain_type", F.col("col.d").alias("target_date"), (F.col("pos") + 1).alias("draw"))
    )


def stratified_split(df: DataFrame, label: str, test_share: float, *key: str, seed: int = C.SAMPLE_SEED) -> DataFrame:
    """Mark an exact share of each label's rows as test: column ``is_test``.

    The test part of a label is its ``floor(share * rows + 0.5)`` lowest md5 ranks. Ranks are counted per four-digit md5
    prefix; whole prefixes below the cut are test, those above are train, and only the one prefix that holds the cut is
    ranked row by row. So a label with most of the rows is never sorted in one task.
    """
    keyed = df.withColumn("_rank", X.sampling_rank(*key, seed=seed)).withColumn("_prefix", F.substring("_rank", 1, 4))
    counts = keyed.groupBy(label, "_prefix").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(label)
    below = Window.partitionBy(label).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    cuts = counts.select(
        label,
        "_prefix",
        F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_below"),
        "_n",
        F.floor(F.sum("_n").over(whole) * F.lit(test_share) + F.lit(0.5)).alias("_cut"),
    )
    placed = keyed.join(cuts, [label, "_prefix"])
    inside = (F.col("_below") < F.col("_cut")) & (F.col("_below") + F.col("_n") > F.col("_cut"))
    order = Window.partitionBy(label, "_prefix").orderBy("_rank", *key)
    at_cut = placed.filter(inside).withColumn(
        "is_test", (F.col("_below") + F.row_number().over(order) <= F.col("_cut")).cast("int")
    )
    clear = placed.filter(~inside).withColumn("is_test", (F.col("_below") < F.col("_cut")).cast("int"))
    return at_cut.unionByName(clear).drop("_rank", "_prefix", "_below", "_n", "_cut")
