"""Search over model settings: generations of candidates as tables.

A generation is a DataFrame with a row per slot. The first one holds the default settings and random ones; every later one holds the elite of
the ranked generation before it and children of elite pairs. All draws are md5 fractions of (seed, generation, slot, what is drawn), so a
generation is a function of the ranked table alone and the same in any engine. Fits run on Spark side by side; the scores of a generation are
rated in one job.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from emberline import config as C
from emberline.operators.metrics import population_fitness
from emberline.operators.model import FittedModel, TrainingSet, fit, prepare_training, settings_of
from emberline.operators.sampling import random_subset
from emberline.sources import sinks

Space = dict[str, tuple]


def fraction(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) from the md5 of seed and parts."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.lit(p) if isinstance(p, str) else p.cast("string")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def drawn(space: Space, seed: int, generation: int) -> dict[str, Column]:
    """Settings drawn evenly from their ranges, for a table with ``slot``."""
    out = {}
    for name, (low, high, _, whole) in space.items():
        u = fraction(seed, str(generation), F.col("slot"), name)
        out[name] = F.lit(float(low)) + (F.floor(u * (high - low + 1)) if whole else u * float(high - low))
    return out


def first_candidates(
    spark: SparkSession, settings: C.SearchConfig = C.SearchConfig(), space: Space = C.SEARCH_SPACE
) -> DataFrame:
    """slot, model_id and a column per searched setting: some with the defaults, moved into the space, the others random."""
    base = C.ModelConfig()
    default = {n: float(min(hi, max(lo, getattr(base, n)))) for n, (lo, hi, _, _) in space.items()}
    is_default = F.col("slot") < settings.default_members
    slots = spark.range(settings.population_size).select(F.col("id").cast("int").alias("slot"))
    values = {n: F.when(is_default, F.lit(default[n])).otherwise(v) for n, v in drawn(space, settings.seed, 0).items()}
    return slots.select("slot", F.format_string("g0-%d", "slot").alias("model_id"), *[v.cast("double").alias(n) for n, v in values.items()])


def tournament(settings: C.SearchConfig, generation: int, side: str) -> Column:
    """Rank (from 1) of a parent: the best of ``tournament_size`` elite members, those whose draws are lowest for the slot."""
    seed = settings.seed
    entries = F.transform(
        F.sequence(F.lit(1), F.lit(settings.elite_count)),
        lambda r: F.struct(fraction(seed, str(generation), F.col("slot"), side, r).alias("u"), r.alias("r")),
    )
    return F.array_min(F.transform(F.slice(F.array_sort(entries), 1, settings.tournament_size), lambda e: e["r"]))


def next_candidates(
    ranked: DataFrame, generation: int, settings: C.SearchConfig = C.SearchConfig(), space: Space = C.SEARCH_SPACE
) -> DataFrame:
    """The candidates after ``ranked`` (model_id, fitness, settings): the elite as it is, then a child in every other slot.

    A child takes whole-number settings from either parent and the others from between the two, or copies one parent; then
    each setting moves by at most its step, with a small chance, within its range. Only the elite, a top-k, is read.
    """
    seed, g, slot = settings.seed, str(generation), F.col("slot")
    names = list(space)
    elite = ranked.orderBy("fitness", "model_id").limit(settings.elite_count).agg(
        F.array_sort(F.collect_list(F.struct("fitness", "model_id", *names))).alias("elite")
    ).scalar()
    size = F.least(F.size(elite), F.lit(settings.elite_count))
    slots = ranked.sparkSession.range(settings.population_size).select(F.col("id").cast("int").alias("slot"))
    # With fewer members than an elite has, ranks wrap around.
    wrapped = lambda r: F.element_at(elite, F.pmod(r - 1, size) + 1)
    placed = slots.withColumns({"a": wrapped(tournament(settings, generation, "a")), "b": wrapped(tournament(settings, generation, "b"))})
    crossed = fraction(seed, g, slot, "cross") < settings.crossover_rate
    copied = F.when(fraction(seed, g, slot, "copy") < 0.5, F.col("a")).otherwise(F.col("b"))
    own = F.get(elite, slot)
    columns = []
    for name, (low, high, step, whole) in space.items():
        a, b = F.col(f"a.{name}"), F.col(f"b.{name}")
        u = fraction(seed, g, slot, name, "mix")
        child = F.when(crossed, F.when(u < 0.5, a).otherwise(b) if whole else a + u * (b - a)).otherwise(copied[name])
        v = fraction(seed, g, slot, name, "by")
        move = F.floor(v * (2 * step + 1)) - step if whole else (v * 2 - 1) * float(step)
        moved = F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), child + move))
        child = F.when(fraction(seed, g, slot, name, "move") < settings.mutation_rate, moved).otherwise(child)
        columns.append(F.when(slot < size, own[name]).otherwise(child).cast("double").alias(name))
    model_id = F.when(slot < size, own["model_id"]).otherwise(F.format_string(f"g{generation}-%d", "slot"))
    return placed.select("slot", model_id.alias("model_id"), *columns)


def config_of(row, space: Space = C.SEARCH_SPACE) -> C.ModelConfig:
    """A candidate row as the settings of a fit."""
    found = {n: int(row[n]) if whole else float(row[n]) for n, (_, _, _, whole) in space.items()}
    return C.ModelConfig.from_dict({**C.ModelConfig().to_dict(), **found})


def fit_all(
    configs: dict[str, C.ModelConfig], training: TrainingSet, parallel: int, deadline: float = float("inf")
) -> dict[str, FittedModel]:
    """Fits side by side, as the cross validator of ``pyspark.ml`` runs them. Candidates that differ in their number of trees alone share
    one fit, that of the most trees. No fit begins after ``deadline``, and those under way
    stop at their next doubling; what was not fitted is missing in the result."""
    if not configs:
        return {}
    shared: dict[tuple, list[tuple[str, C.ModelConfig]]] = {}
    for item in sorted(configs.items(), key=lambda x: (-x[1].n_estimators, x[0])):
        shared.setdefault(settings_of(item[1]), []).append(item)

    def work(group: list[tuple[str, C.ModelConfig]]) -> list[FittedModel]:
        return [fit(training, config, name, deadline) for name, config in group] if time.monotonic() < deadline else []

    with ThreadPool(min(parallel, len(shared))) as pool:
        done = pool.map(inheritable_thread_target(SparkSession.active())(work), shared.values(), chunksize=1)
    return {m.model_id: m for group in done for m in group}


def rated(models: list[FittedModel], test_rows: DataFrame) -> DataFrame:
    """model_id and fitness of all models in one job: their scores in one long table, one grouped loss."""
    scores = reduce(DataFrame.unionByName, [m.long_scores(test_rows) for m in models])
    names = test_rows.sparkSession.createDataFrame([(m.model_id, None) for m in models], "model_id string, mean_seconds double")
    return population_fitness(scores, names)


HISTORY = (
    "generation int, fitness double, best_fitness double, mean_fitness double, n_fitted int, n_missing int, ended string, seconds double"
)


def search_summary(history: DataFrame) -> DataFrame:
    """One row: generations, best fitness, mean seconds, and the best fitness so far of every generation in order."""
    return history.agg(
        F.count("*").alias("generations"),
        F.min("best_fitness").alias("best_fitness"),
        F.avg("seconds").alias("mean_seconds"),
        F.sort_array(F.collect_list(F.struct("generation", "best_fitness")))["best_fitness"].alias("fitness_history"),
    )


@dataclass
class SearchResult:
    best: FittedModel | None = None
    history: list[tuple] = field(default_factory=list)
    training_seconds: float = 0.0
    evaluation_seconds: float = 0.0
    ended: str = "generations"

    def history_table(self, spark: SparkSession) -> DataFrame:
        """A row per generation; the last one says why the search ended (converged, generations or time)."""
        rows = [(*row[:-1], self.ended if row is self.history[-1] else None, row[-1]) for row in self.history]
        return spark.createDataFrame(rows, HISTORY)

    def summary(self, spark: SparkSession) -> DataFrame:
        return search_summary(self.history_table(spark)).withColumns(
            {
                "best_model_id": F.lit(self.best.model_id),
                "training_seconds": F.lit(self.training_seconds),
                "evaluation_seconds": F.lit(self.evaluation_seconds),
            }
        )

    def write_summary(self, spark: SparkSession, path: str) -> None:
        sinks.write_json(self.summary(spark), path)


def converged(best: list[float], patience: int, decimals: int = 4) -> bool:
    return len(best) >= patience and len({round(v, decimals) for v in best[-patience:]}) == 1


def search(
    train: DataFrame, pool: DataFrame, settings: C.SearchConfig = C.SearchConfig(), space: Space = C.SEARCH_SPACE
) -> SearchResult:
    """Rate generation after generation until the best fitness stands still, the last generation is done or the time is over.

    A generation's rows are as many as the population, so they are read on the driver to start the fits. Equal settings are fitted once
    over all generations, and trees grown for a candidate of an earlier one are taken up while it is among the candidates. After
    ``max_seconds`` no fit begins; candidates that were not fitted have no fitness, and the search ends with that generation.
    """
    spark, result, models, best = train.sparkSession, SearchResult(), {}, float("inf")
    training, pool, ranked = prepare_training(train), pool.persist(), None
    deadline = time.monotonic() + settings.max_seconds
    try:
        for generation in range(settings.max_generations):
            begun = time.perf_counter()
            candidates = first_candidates(spark, settings, space) if ranked is None else next_candidates(ranked, generation, settings, space)
            rows = {r.model_id: r.asDict() for r in candidates.collect()}
            configs = {k: config_of(r, space) for k, r in rows.items()}
            # What the ranked generation had beside its elite goes before the next one is fitted: trees are held on the driver.
            kept = {settings_of(c) for c in configs.values()}
            training.grown = {k: g for k, g in training.grown.items() if k in kept}
            models = {k: m for k, m in models.items() if k in rows}
            fresh = fit_all({k: c for k, c in configs.items() if k not in models}, training, settings.parallel_fits, deadline)
            models.update(fresh)
            if not models:
                result.ended = "time"
                break
            fitted_at = time.perf_counter()
            asked = random_subset(pool, settings.test_samples_per_generation, "cell_id", "target_date", seed=generation).persist()
            fitness = {r.model_id: r.fitness for r in rated(list(models.values()), asked).collect()}
            asked.unpersist()
            leader = min(fitness, key=lambda k: (fitness[k], k))
            if result.best is None or fitness[leader] < best:
                best, result.best = fitness[leader], models[leader]
            done = time.perf_counter()
            result.training_seconds += fitted_at - begun
            result.evaluation_seconds += done - fitted_at
            missing = len(rows) - len(models)
            result.history.append((generation, fitness[leader], best, sum(fitness.values()) / len(fitness), len(fresh), missing, done - begun))
            if converged([row[2] for row in result.history], settings.patience):
                result.ended = "converged"
                break
            if time.monotonic() >= deadline:
                result.ended = "time"
                break
            table = [(k, fitness.get(k, float("inf")), *[r[n] for n in space]) for k, r in rows.items()]
            ranked = spark.createDataFrame(table, "model_id string, fitness double, " + ", ".join(f"{n} double" for n in space))
    finally:
        training.release()
        pool.unpersist()
    return result
