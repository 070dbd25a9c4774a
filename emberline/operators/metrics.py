"""Scores of models: one long table (model_id, y, p) in, one row per model out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from emberline import config as C
from emberline.functions import exprs as X

CLIP = 1e-15
# Score buckets of a model, a power of two.
SCORE_BUCKETS = 256


def log_loss(y: Column, p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(CLIP)), F.lit(1.0 - CLIP))
    return -F.avg(F.when(y > 0, F.log(q)).otherwise(F.log(F.lit(1.0) - q)))


def ranked_area(scores: DataFrame) -> DataFrame:
    """Area under the ROC curve per model, ties counted half; 0.5 where only one class occurs.

    Rows are first folded to one per (model, score). The running count of negatives is then taken in two steps, within
    score buckets and over bucket totals. Bucket edges are quantiles of a model's different scores, wherever they crowd, so no task
    sorts more than a small share of them. The edges only deal the work out.
    """
    groups = (
        scores.groupBy("model_id", "p")
        .agg(F.count(F.when(F.col("y") > 0, 1)).alias("pos"), F.count(F.when(F.col("y") <= 0, 1)).alias("neg"))
    )
    shares = F.array(*[F.lit(k / SCORE_BUCKETS) for k in range(1, SCORE_BUCKETS)])
    edges = groups.groupBy("model_id").agg(F.percentile_approx("p", shares, 2 * SCORE_BUCKETS).alias("edges"))

    def climb(at: Column, jump: Column) -> Column:
        return F.when(F.get("edges", at + jump - 1) <= F.col("p"), at + jump).otherwise(at)

    jumps = F.array(*[F.lit(1 << k) for k in reversed(range(SCORE_BUCKETS.bit_length() - 1))])
    groups = groups.join(edges, "model_id").withColumn("bucket", F.aggregate(jumps, F.lit(0), climb)).drop("edges")
    below = Window.partitionBy("model_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        groups.groupBy("model_id", "bucket")
        .agg(F.sum("neg").alias("neg"))
        .select("model_id", "bucket", F.coalesce(F.sum("neg").over(below), F.lit(0)).alias("base"))
    )
    inside = Window.partitionBy("model_id", "bucket").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    won = F.col("pos").cast("double") * (
        F.col("base") + F.coalesce(F.sum("neg").over(inside), F.lit(0)) + F.col("neg") * F.lit(0.5)
    )
    return (
        groups.join(buckets, ["model_id", "bucket"])
        .withColumn("won", won)
        .groupBy("model_id")
        .agg(F.sum("won").alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .select(
            "model_id",
            F.coalesce(
                F.try_divide(F.col("won"), F.col("pos").cast("double") * F.col("neg").cast("double")), F.lit(0.5)
            ).alias("roc_auc"),
        )
    )


def model_metrics(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Log loss, ROC area, precision, recall, F1 and positive rate per model."""
    y, called = F.col("y") > 0, F.col("p") > threshold
    hits = F.count(F.when(y & called, 1))
    counts = scores.groupBy("model_id").agg(
        F.count("*").alias("n_rows"),
        log_loss(F.col("y"), F.col("p")).alias("log_loss"),
        hits.alias("_tp"),
        F.count(F.when(called, 1)).alias("_called"),
        F.count(F.when(y, 1)).alias("_pos"),
    )

    def ratio(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    return (
        counts.withColumns(
            {
                "precision": ratio(F.col("_tp"), F.col("_called")),
                "recall": ratio(F.col("_tp"), F.col("_pos")),
                "f1_score": ratio(F.col("_tp") * 2, F.col("_called") + F.col("_pos")),
                "fire_rate": F.col("_pos") / F.col("n_rows"),
            }
        )
        .drop("_tp", "_called", "_pos")
        .join(ranked_area(scores), "model_id")
    )


def population_fitness(scores: DataFrame, models: DataFrame, slow_after: float = 1.0, penalty: float = 0.1) -> DataFrame:
    """Fitness per model: log loss, plus a penalty for slow predictions; a model without scores is infinitely bad.

    ``models`` has model_id and mean_seconds (mean prediction time, may be null).
    """
    losses = scores.groupBy("model_id").agg(log_loss(F.col("y"), F.col("p")).alias("loss"))
    late = F.greatest(F.coalesce(F.col("mean_seconds"), F.lit(0.0)) - F.lit(slow_after), F.lit(0.0))
    return models.join(losses, "model_id", "left").select(
        "model_id",
        F.coalesce(F.col("loss") + late * F.lit(penalty), F.lit(float("inf"))).alias("fitness"),
    )


def leaderboard(fitness: DataFrame, k: int | None = None) -> DataFrame:
    """Models by fitness, best first; the best ``k`` when given."""
    ordered = fitness.orderBy("fitness", "model_id")
    return ordered if k is None else ordered.limit(k)


def fitness_summary(fitness: DataFrame) -> DataFrame:
    return fitness.agg(
        F.min("fitness").alias("best"), F.max("fitness").alias("worst"), F.avg("fitness").alias("mean")
    )


def best_history(history: DataFrame) -> DataFrame:
    """Best fitness so far per generation. A history has one row per generation, so one ordered window is small."""
    so_far = Window.orderBy("generation").rowsBetween(Window.unboundedPreceding, 0)
    return history.withColumn("best_fitness", F.min("fitness").over(so_far))


def convergence(history: DataFrame, patience: int = 3, decimals: int = 4) -> DataFrame:
    """Generations at which the best fitness has stood still for ``patience`` generations."""
    recent = Window.orderBy("generation").rowsBetween(-(patience - 1), 0)
    rounded = F.round("best_fitness", decimals)
    still = (F.count("best_fitness").over(recent) == patience) & (F.min(rounded).over(recent) == F.max(rounded).over(recent))
    return history.withColumn("converged", still.cast("int"))


def baseline_scores(requests: DataFrame, samples: DataFrame) -> DataFrame:
    """Neighbourhood-mean score of (cell_id, target_date) requests.

    The mean label of samples of the same cell or of forest, times a seasonal factor, kept within 0.05 and 0.95; the mean
    over all samples where neither exists. The either-or is split into two disjoint sums (forest, and other samples
    of the cell), which replaces a join on a disjunction by an equi-join with per-cell sums.
    """
    forest = X.holds(F.col("terrain_type") == "forest")
    y = F.col("fire_occurred").cast("double")
    totals = samples.agg(
        F.struct(
            F.coalesce(F.sum(F.when(forest, y)), F.lit(0.0)).alias("forest_sum"),
            F.count(F.when(forest & y.isNotNull(), 1)).alias("forest_n"),
            F.avg(y).alias("all_mean"),
        )
    ).scalar()
    others = (
        samples.filter(~forest)
        .groupBy("cell_id")
        .agg(F.coalesce(F.sum(y), F.lit(0.0)).alias("cell_sum"), F.count(y).alias("cell_n"))
    )
    mean = F.coalesce(
        F.try_divide(
            totals["forest_sum"] + F.coalesce("cell_sum", F.lit(0.0)), totals["forest_n"] + F.coalesce("cell_n", F.lit(0))
        ),
        totals["all_mean"],
    )
    score = F.least(F.lit(0.95), F.greatest(F.lit(0.05), mean * X.seasonal_factor(F.month("target_date"))))
    return requests.join(others, "cell_id", "left").select(
        *requests.columns, score.alias("fire_probability"), F.lit(0.8).alias("confidence")
    )
