"""The registered queries: one per group of operators, each over the whole tables it reads."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberline import config as C
from emberline.functions import exprs as X
from emberline.operators import features, fires, geo, grid, interpolate as ip, metrics, profile, sampling, validate, weather
from emberline.plans.adapters import view
from emberline.plans.workspace import Workspace
from emberline.session import reliable_cut, scratch_path
from emberline.sources import declared, fire_files, sinks, station_text
from emberline.sources.tables import read_csv, read_table

# Grid spacing of the queries.
GRID_KM = 100.0
# The test stations are sparse and report a quarter of all days, so confidence is low everywhere.
CONFIDENCE_MIN = {"forest": 0.105, "land": 0.105, "urban": 0.105, "water": 0.1}
# Time after which the registered search begins no fit: it has none, and ends when it has converged or with its last generation.
SEARCH_SECONDS = float("inf")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six decimals and days to text, so that two engines can be compared value by value."""
    columns = []
    for name, kind in df.dtypes:
        if kind == "double":
            columns.append(F.round(name, 6).alias(name))
        elif kind == "date" or kind.startswith("decimal"):
            columns.append(F.col(name).cast("string").alias(name))
        else:
            columns.append(F.col(name))
    return df.select(*columns)


# --- domain tables the queries share -------------------------------------------------------------------------------

def stations(spark, d) -> DataFrame:
    return view(spark, d, "a_stations").filter(X.in_bounds("latitude", "longitude"))


def station_weather(spark, d) -> DataFrame:
    return weather.enrich(weather.weather_wide(weather.accept_readings(view(spark, d, "a_readings"))))


def raw_fires(spark, d) -> DataFrame:
    """Fire reports under the source's column names."""
    return view(spark, d, "a_fires").select(
        F.col("fire_id").alias("NFDBFIREID"),
        "line_no",
        F.col("latitude").alias("LATITUDE"),
        F.col("longitude").alias("LONGITUDE"),
        F.col("year").alias("YEAR"),
        F.col("month").alias("MONTH"),
        F.col("day").alias("DAY"),
        F.col("size_ha").alias("SIZE_HA"),
        F.col("rep_date").alias("REP_DATE"),
        F.col("out_date").alias("OUT_DATE"),
        F.col("fire_type").alias("FIRE_TYPE"),
        "geometry_wkt",
    )


def valid_fires(spark, d) -> DataFrame:
    return validate.valid(validate.classify_fires(raw_fires(spark, d)))


def workspace(spark, d, km=GRID_KM, interpolation="idw") -> Workspace:
    return Workspace(
        spark,
        stations(spark, d),
        None,
        lambda: fires.fires_from_reports(valid_fires(spark, d)),
        km=km,
        confidence_min=CONFIDENCE_MIN,
        interpolation=interpolation,
        readings=weather.accept_readings(view(spark, d, "a_readings")),
    )


# --- text and validation ---------------------------------------------------------------------------------------------

@query
def station_scan(spark, d):
    return tidy(station_text.parse_stations(view(spark, d, "a_station_lines")))


@query
def station_scan_collector(spark, d):
    lines = station_text.parse_stations(view(spark, d, "a_station_lines"), min_len=84, strip=False)
    return tidy(validate.valid(lines).filter(F.col("station_id").startswith("CA")))


@query
def inventory_scan(spark, d):
    return tidy(station_text.parse_inventory(view(spark, d, "a_inventory_lines")))


@query
def dly_tokens(spark, d):
    return tidy(station_text.parse_daily(view(spark, d, "a_daily_lines"), "tokens"))


@query
def dly_fixed(spark, d):
    return tidy(station_text.parse_daily(view(spark, d, "a_daily_lines"), "fixed"))


@query
def dly_year_filter(spark, d):
    return station_text.filter_daily_years(view(spark, d, "a_daily_lines"), C.YEAR_FIRST, C.YEAR_LAST)


@query
def year_audit(spark, d):
    return station_text.daily_year_counts(view(spark, d, "a_daily_lines"), C.YEAR_FIRST, C.YEAR_LAST)


@query
def station_match(spark, d):
    kept, unknown = weather.match_stations(
        view(spark, d, "a_daily_lines"), validate.valid(station_text.parse_stations(view(spark, d, "a_station_lines")))
    )
    matched = kept.groupBy("station_id").agg(F.count("*").alias("n_lines")).withColumn("known", F.lit(1))
    missing = unknown.select("station_id", F.lit(0).cast("long").alias("n_lines"), F.lit(0).alias("known"))
    return matched.unionByName(missing)


@query
def weather_wide(spark, d):
    return tidy(weather.weather_wide(weather.accept_readings(view(spark, d, "a_readings"))))


@query
def weather_enriched(spark, d):
    return tidy(
        station_weather(spark, d).select(
            "station_id", "date", "temp_range", "year", "month", "day_of_year", "season", "data_completeness"
        )
    )


@query
def weather_wide_from_text(spark, d):
    """Text lines all the way to enriched rows: parse, last reading wins, pivot."""
    return tidy(weather.enrich(weather.weather_wide(station_text.parse_daily(view(spark, d, "a_daily_lines")))))


@query
def variable_counts(spark, d):
    return profile.non_null_counts(station_weather(spark, d), *weather.MEASURES)


@query
def fire_rejects(spark, d):
    return validate.rule_counts(
        {
            "wildfires": validate.classify_fires(raw_fires(spark, d)),
            "stations": station_text.parse_stations(view(spark, d, "a_station_lines")),
            "station_inventory": station_text.parse_inventory(view(spark, d, "a_inventory_lines")),
        }
    )


@query
def fire_sentinels(spark, d):
    return tidy(validate.drop_sentinel_fires(raw_fires(spark, d)).select("NFDBFIREID", "line_no", "YEAR", "MONTH", "DAY"))


@query
def processed_counts(spark, d):
    return validate.processed_counts(
        {
            "wildfires": validate.classify_fires(raw_fires(spark, d)),
            "stations": station_text.parse_stations(view(spark, d, "a_station_lines")),
        }
    )


@query
def reject_rows(spark, d):
    return validate.reject_rows(validate.classify_fires(raw_fires(spark, d)), "wildfires", "NFDBFIREID")


@query
def fire_valid(spark, d):
    return tidy(
        valid_fires(spark, d).select(
            "NFDBFIREID", "line_no", "LATITUDE", "LONGITUDE", "YEAR", "MONTH", "DAY", "SIZE_HA", "FIRE_TYPE", "CAUSE",
            "layer", "geometry_wkt", "fire_date",
        )
    )


@query
def days_in_layouts(spark, d):
    return tidy(view(spark, d, "a_days").select("line_no", "layout", X.to_day("text").alias("day")))


@query
def fire_csv_layouts(spark, d):
    """CSV lines of three files: two layouts, and one file without a required column."""
    reports, _ = fire_files.parse_layouts(view(spark, d, "a_csv_lines"))
    return reports.select("source_file", "line_no", "LATITUDE", "LONGITUDE", "YEAR", "MONTH", "DAY", "SIZE_HA", "CAUSE")


@query
def fire_csv_skipped(spark, d):
    return fire_files.parse_layouts(view(spark, d, "a_csv_lines"))[1]


@query
def fire_csv_records(spark, d):
    """Records with line breaks, doubled quotes and quotes within plain fields, under a header that has a line break itself."""
    reports, _ = fire_files.parse_layouts(view(spark, d, "a_csv_breaks"))
    return reports.select("source_file", "line_no", "LATITUDE", "LONGITUDE", "SIZE_HA", F.col("`CAUSE\nTEXT`").alias("cause"))


@query
def fire_csv_left_open(spark, d):
    """Files that end inside quotes, named instead of read."""
    return fire_files.parse_layouts(view(spark, d, "a_csv_breaks"))[1]


@query
def fire_polygon_box(spark, d):
    return view(spark, d, "a_shapes").select("shape_id", geo.polygon_meets_box("geometry_wkt").cast("int").alias("meets"))


@query
def value_counts(spark, d):
    return profile.value_counts(valid_fires(spark, d), "FIRE_TYPE", "YEAR")


@query
def range_profile(spark, d):
    return tidy(profile.range_profile(valid_fires(spark, d), "YEAR", "LATITUDE", "LONGITUDE"))


# --- stations ----------------------------------------------------------------------------------------------------------

@query
def station_pairs(spark, d):
    return tidy(geo.pairs_within(stations(spark, d)))


@query
def station_neighbors(spark, d):
    return tidy(geo.station_neighbors(stations(spark, d)))


@query
def run_metadata(spark, d):
    s, r = stations(spark, d), view(spark, d, "a_readings")
    before = profile.table_counts(
        {"stations": (view(spark, d, "a_stations"), "all stations"), "fires": (view(spark, d, "a_fires"), "fire reports")}
    )
    after = profile.table_counts({"stations": (s, "stations inside the box"), "readings": (r, "daily readings")}, written=1)
    return profile.upsert_metadata(before, after)


# --- stored tables ------------------------------------------------------------------------------------------------------

@query
def declared_tables(spark, d):
    """Tables written under their declarations and read back: rows, missing values and repeated keys of each."""
    ws, root = workspace(spark, d), scratch_path(spark, "declared")
    made = {
        "stations": (stations(spark, d), declared.STATIONS),
        "station_neighbors": (geo.station_neighbors(stations(spark, d)), declared.STATION_NEIGHBORS),
        "grid_cells": (ws.cells, declared.GRID_CELLS),
        "cell_station": (ws.assigned, declared.CELL_STATION),
        "fire_events": (sinks.with_json_cells(ws.events), declared.FIRE_EVENTS),
        "cell_fire": (ws.cell_fire, declared.CELL_FIRE),
    }
    parts = []
    for name, (df, table) in made.items():
        declared.write_declared(df, f"{root}/{name}", table)
        found = declared.report(declared.read_declared(spark, f"{root}/{name}", table), table)
        parts.append(found.select(F.lit(name).alias("table_name"), "*"))
    return reduce(DataFrame.unionByName, parts)


@query
def refused_overwrite(spark, d):
    """The stations of a table that was written, then overwritten with every id twice: the second write is refused."""
    kept, root = stations(spark, d), scratch_path(spark, "refused")
    declared.write_declared(kept, root, declared.STATIONS)
    repeated = kept.unionByName(kept.withColumn("name", F.lit("again")))
    try:
        declared.write_declared(repeated, root, declared.STATIONS)
    except declared.DeclarationError:
        return tidy(declared.read_declared(spark, root, declared.STATIONS))
    raise AssertionError("a table with repeated keys was committed")


@query
def csv_round_trip(spark, d):
    """Fire reports through the CSV sink and back, with remarks that hold quotes, commas, line breaks, blanks, nothing or null."""
    kind = F.col("line_no") % 6
    remark = (
        F.when(kind == 0, F.lit("")).when(kind == 1, F.lit('say "x", then y')).when(kind == 2, F.lit("two\nlines"))
        .when(kind == 3, F.lit("  blanks \\ ")).when(kind == 4, F.lit('"'))
    )
    rows = raw_fires(spark, d).withColumn("REMARK", remark)
    path = scratch_path(spark, "csv")
    sinks.write_csv(rows, path)
    return tidy(read_csv(spark, path, rows.schema).select("NFDBFIREID", "line_no", "LATITUDE", "YEAR", "FIRE_TYPE", "geometry_wkt", "REMARK"))


@query
def samples_round_trip(spark, d):
    """The training samples through the CSV sink and back."""
    path = scratch_path(spark, "samples")
    sinks.write_table(workspace(spark, d).samples("train"), f"{path}/table")
    samples = read_table(spark, f"{path}/table")
    sinks.write_csv(samples, f"{path}/csv")
    return tidy(read_csv(spark, f"{path}/csv", samples.schema))


# --- grid --------------------------------------------------------------------------------------------------------------

def station_regions(spark, d) -> DataFrame:
    """A box of one by two degrees around every station, as named regions."""
    return stations(spark, d).select(
        F.col("station_id").alias("region_id"),
        (F.col("latitude") - 0.5).alias("lat_min"),
        (F.col("latitude") + 0.5).alias("lat_max"),
        (F.col("longitude") - 1.0).alias("lon_min"),
        (F.col("longitude") + 1.0).alias("lon_max"),
    )


@query
def grid_cells(spark, d):
    return tidy(grid.grid_of_regions(station_regions(spark, d), 30.0))


@query
def terrain(spark, d):
    return profile.terrain_counts(grid.with_terrain(grid.grid_of_regions(station_regions(spark, d), 30.0)))


@query
def cell_station(spark, d):
    return tidy(workspace(spark, d).assigned)


@query
def interp_idw(spark, d):
    return tidy(workspace(spark, d).weather)


@query
def interp_nearest(spark, d):
    return tidy(workspace(spark, d, GRID_KM, "nearest").weather)


@query
def interp_monthly(spark, d):
    """The 100 km grid, folded to months: days, methods, mean confidence and temperature per cell."""
    return tidy(
        workspace(spark, d)
        .weather.groupBy("cell_id", "year", "month")
        .agg(
            F.count("*").alias("n_days"),
            F.sum("station_count_used").alias("n_reports"),
            F.count(F.when(F.col("interpolation_method") == "seasonal_default", 1)).alias("n_default"),
            F.avg("confidence_score").alias("mean_confidence"),
            F.avg("tavg").alias("mean_tavg"),
            F.sum("prcp").alias("total_prcp"),
        )
    )


@query
def seasonal_defaults(spark, d):
    """Defaults for every station and day without a mean temperature."""
    lacking = station_weather(spark, d).filter(F.col("tavg").isNull())
    values = X.seasonal_defaults("month")
    return tidy(
        lacking.select("station_id", "date", "season", *[values[m].alias(m) for m in ip.MIXED_MEASURES])
    )


@query
def weather_summary(spark, d):
    ws = workspace(spark, d)
    return tidy(profile.weather_summary(ws.assigned, ws.days))


@query
def all_dates(spark, d):
    """Every day any station reports, in order."""
    return tidy(profile.distinct_dates(station_weather(spark, d)))


@query
def weather_dates(spark, d):
    """Day list and a day-list scan: rows on the days of the first fires only."""
    days = valid_fires(spark, d).select(F.col("fire_date").alias("date")).distinct()
    rows = station_weather(spark, d).join(days, "date", "left_semi")
    return tidy(rows.groupBy("date").agg(F.count("*").alias("n_stations")).orderBy("date"))


# --- fires -------------------------------------------------------------------------------------------------------------

@query
def fire_events(spark, d):
    events = fires.fire_events(workspace(spark, d).burned_lines)
    return tidy(events.withColumn("affected_cells", F.to_json("affected_cells")))


def two_files(spark, d) -> DataFrame:
    """Affected cells of fire reports of two files that number their lines alike."""
    rows = view(spark, d, "a_fire_files").filter(F.col("month").between(1, 12))
    return fires.burned_lines(rows, workspace(spark, d).land, workspace(spark, d).cell_bound)


@query
def fire_events_of_files(spark, d):
    events = fires.fire_events(two_files(spark, d)).select("fire_id", "center_cell_id", "start_date", "end_date", "total_size_ha", "affected_cells")
    return tidy(events.withColumn("affected_cells", F.to_json("affected_cells")))


@query
def cell_fires_of_files(spark, d):
    return tidy(fires.cell_fires(two_files(spark, d)))


@query
def cell_fire_table(spark, d):
    return tidy(fires.cell_fires(workspace(spark, d).burned_lines))


@query
def fire_summary(spark, d):
    ws = workspace(spark, d)
    return tidy(profile.fire_summary(ws.events, fires.cell_fires(ws.burned)))


@query
def sample_fire_status(spark, d):
    """Whether a fire burns on the day of each training sample, by merged intervals."""
    ws = workspace(spark, d)
    keys = ws.sample_keys("train").withColumnRenamed("target_date", "date")
    return tidy(fires.fire_status_in_spans(keys, ws.cell_fire))


@query
def fire_status(spark, d):
    """Burning flag for every cell that ever burned, on each day of the readings."""
    ws = workspace(spark, d)
    days = view(spark, d, "a_readings").agg(F.collect_set("date")).scalar()
    keys = ws.cell_fire.select("cell_id").distinct().select("cell_id", F.explode(days).alias("date"))
    return tidy(fires.fire_status(keys, ws.fire_days))


@query
def fire_history_cells(spark, d):
    ws = workspace(spark, d)
    return fires.cells_with_history(fires.cell_fires(ws.burned), ws.events)


@query
def no_fire_cells(spark, d):
    ws = workspace(spark, d)
    return sampling.no_fire_cells(ws.cells, fires.cell_fires(ws.burned_lines)).select("cell_id", "terrain_type")


# --- samples -----------------------------------------------------------------------------------------------------------

@query
def cell_stats(spark, d):
    return tidy(
        workspace(spark, d)
        .stats.filter(F.col("data_days") >= C.MIN_DAYS_TARGET)
        .select("cell_id", "terrain_type", "avg_confidence", "data_days", "fire_count")
    )


@query
def target_cells_default(spark, d):
    """Target cells under the default thresholds of confidence, which few of the sparse test stations' cells reach."""
    found = sampling.target_cells(workspace(spark, d).stats)
    return tidy(found.select("cell_id", "terrain_type", "is_water", "urban_flag", "avg_confidence", "data_days", "fire_count"))


@query
def target_cells(spark, d):
    return tidy(
        workspace(spark, d).targets.select(
            "cell_id", "terrain_type", "is_water", "urban_flag", "avg_confidence", "data_days", "fire_count"
        )
    )


@query
def pool_cells(spark, d):
    chosen = sampling.pool_cells(workspace(spark, d).stats)
    return tidy(sampling.random_order(chosen, "cell_id").select("cell_id", "terrain_type", "data_days", "avg_confidence"))


@query
def sample_dates(spark, d):
    ws = workspace(spark, d)
    parts = [ws.dates(kind).withColumn("kind", F.lit(kind)) for kind in ("train", "test")]
    return tidy(reduce(DataFrame.unionByName, parts))


@query
def cell_neighbors(spark, d):
    ws = workspace(spark, d)
    return tidy(grid.lattice_neighbors(ws.targets, ws.km, ws.bounds))


@query
def yearly_features(spark, d):
    ws = workspace(spark, d)
    return tidy(features.yearly_features(ws.sample_keys("train"), ws.sample_weather, ws.fire_days))


@query
def neighbor_features(spark, d):
    ws = workspace(spark, d)
    return tidy(features.neighbor_features(ws.sample_keys("train"), ws.neighbors, ws.sample_weather, ws.fire_days))


@query
def cell_features(spark, d):
    ws = workspace(spark, d)
    return tidy(features.cell_features(ws.cells, fires.cell_fires(ws.burned_lines)))


@query
def training_samples(spark, d):
    return tidy(workspace(spark, d).samples("train"))


@query
def dataset_metadata(spark, d):
    ws = workspace(spark, d)
    return profile.dataset_metadata(reliable_cut(ws.samples("train"), "train"), ws.samples("test"))


@query
def feature_profile(spark, d):
    return tidy(profile.feature_profile(workspace(spark, d).samples("train"), *C.FEATURE_COLUMNS))


@query
def class_balance(spark, d):
    return tidy(profile.class_balance(view(spark, d, "a_labelled")))


@query
def pool_summary(spark, d):
    return tidy(profile.pool_summary(view(spark, d, "a_labelled")))


@query
def split_8020(spark, d):
    return sampling.stratified_split(view(spark, d, "a_graded"), "quality", 0.2, "doc_id").select("doc_id", "quality", "is_test")


@query
def generation_subset(spark, d):
    subset = sampling.random_subset(view(spark, d, "a_labelled"), C.SearchConfig().test_samples_per_generation, "sample_id", seed=3)
    return tidy(subset)


# --- scores ------------------------------------------------------------------------------------------------------------

@query
def model_metrics(spark, d):
    return tidy(metrics.model_metrics(view(spark, d, "a_scores")))


@query
def baseline_scores(spark, d):
    return tidy(metrics.baseline_scores(view(spark, d, "a_requests"), view(spark, d, "a_labelled")))


@query
def population_fitness(spark, d):
    fitness = metrics.population_fitness(view(spark, d, "a_scores"), view(spark, d, "a_models"))
    finite = F.col("fitness") < float("inf")
    return tidy(metrics.leaderboard(fitness).select("model_id", F.when(finite, F.col("fitness")).alias("fitness")))


@query
def elite(spark, d):
    return tidy(metrics.leaderboard(metrics.population_fitness(view(spark, d, "a_scores"), view(spark, d, "a_models")), 3))


@query
def best_history(spark, d):
    return tidy(metrics.best_history(view(spark, d, "a_generations")))


@query
def convergence(spark, d):
    return tidy(metrics.convergence(metrics.best_history(view(spark, d, "a_generations"))))


@query
def next_candidates(spark, d):
    """The third generation out of a ranked population."""
    from emberline.operators.search import next_candidates as following

    return tidy(following(view(spark, d, "a_population"), 3))


@query
def search_summary(spark, d):
    """Generations, best fitness and the best fitness so far, of a history."""
    from emberline.operators.search import search_summary as summary

    history = metrics.best_history(view(spark, d, "a_generations")).withColumn("seconds", F.col("generation") / 10)
    found = summary(history)
    return tidy(found.withColumn("fitness_history", F.to_json("fitness_history")))


@query
def gbt_scores(spark, d):
    """Train on the training samples and score the test samples (rows only: trees have no SQL twin)."""
    from emberline.operators.model import train

    ws = workspace(spark, d)
    fitted = train(reliable_cut(ws.samples("train"), "train"))
    return tidy(fitted.score(ws.samples("test")))


@query
def gbt_scores_valid(spark, d):
    """Key and label of every scored test sample, whether its score is a probability, and whether a model that was saved and loaded gives
    the same one."""
    from emberline.operators.model import FittedModel, train

    ws = workspace(spark, d)
    fitted, test = train(reliable_cut(ws.samples("train"), "train")), reliable_cut(ws.samples("test"), "test")
    path = scratch_path(spark, "model")
    fitted.save(spark, path)
    score = F.col("fire_probability")
    again = FittedModel.load(spark, path).score(test).groupBy("cell_id", "target_date").agg(F.min(score).alias("low"), F.max(score).alias("high"))
    return fitted.score(test).join(again, ["cell_id", "target_date"]).select(
        "cell_id", F.col("target_date").cast("string").alias("target_date"), "fire_occurred", score.between(0, 1).cast("int").alias("is_probability"),
        ((score == F.col("low")) & (score == F.col("high"))).cast("int").alias("is_same_when_loaded"),
    )


@query
def model_features(spark, d):
    """The training samples as the trees see them: nulls filled, texts as codes by falling frequency."""
    from emberline.operators import model

    filled = model.fill_missing(reliable_cut(workspace(spark, d).samples("train"), "train"))
    coded = model.feature_pipeline(filled).fit(filled).transform(filled)
    names = [c if t != "string" else f"{c}_code" for c, t in filled.dtypes if c not in model.NOT_FEATURES]
    return tidy(coded.select("cell_id", "target_date", "fire_occurred", *[F.col(c).cast("double").alias(c) for c in names]))


@query
def search_history(spark, d):
    """The search with its default settings over the samples (rows only), to its end: every candidate of every generation is fitted, which
    is a matter of hours. The last row says why it ended."""
    from emberline.operators.search import search

    ws = workspace(spark, d)
    train, test = reliable_cut(ws.samples("train"), "train"), reliable_cut(ws.samples("test"), "test")
    found = search(train, test, C.SearchConfig(max_seconds=SEARCH_SECONDS), space=C.SEARCH_SPACE)
    return tidy(found.history_table(spark).drop("seconds"))
