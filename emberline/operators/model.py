"""Class-weighted boosted trees on the sample table."""

from __future__ import annotations

import json
import math
import time
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from emberline import config as C
from emberline.operators.metrics import model_metrics
from emberline.operators.profile import class_balance
from emberline.operators.sampling import stratified_split

LABEL = "fire_occurred"
NOT_FEATURES = ("cell_id", "target_date", LABEL)
# Training rows of a task, and the least number of tasks. Each level of each tree is two stages whose every task reports to the driver, so
# tasks must follow the rows, not the number of partitions that shuffles and files before them happened to have.
ROWS_PER_TASK, LEAST_TASKS = 5_000, 2
# Settings when the labels have a single class.
PLAIN = C.ModelConfig(max_depth=3, n_estimators=10, subsample=1.0, colsample=1.0)


def feature_pipeline(samples: DataFrame) -> Pipeline:
    """Text columns to category codes (learnt once, from the training rows), then one vector."""
    types = dict(samples.dtypes)
    names = [c for c in samples.columns if c not in NOT_FEATURES and not c.startswith("_")]
    text = [c for c in names if types[c] == "string"]
    numeric = [c for c in names if types[c] != "string"]
    indexers = [StringIndexer(inputCol=c, outputCol=f"{c}_code", handleInvalid="keep") for c in text]
    assembler = VectorAssembler(inputCols=numeric + [f"{c}_code" for c in text], outputCol="features")
    return Pipeline(stages=[*indexers, assembler])


def fill_missing(samples: DataFrame) -> DataFrame:
    numeric = [c for c, t in samples.dtypes if t in ("double", "float", "int", "bigint")]
    return samples.fillna(0.0, subset=numeric)


@dataclass
class FittedModel:
    model_id: str
    config: C.ModelConfig
    features: PipelineModel
    trees: GBTClassificationModel
    training_seconds: float = 0.0

    def score(self, samples: DataFrame) -> DataFrame:
        """Fire probability of each row, next to its key and label."""
        scored = self.trees.transform(self.features.transform(fill_missing(samples)))
        probability = vector_to_array("probability")[1]
        keep = [c for c in NOT_FEATURES if c in samples.columns]
        return scored.select(F.lit(self.model_id).alias("model_id"), *keep, probability.alias("fire_probability"))

    def long_scores(self, samples: DataFrame) -> DataFrame:
        return self.score(samples).select("model_id", F.col(LABEL).alias("y"), F.col("fire_probability").alias("p"))

    def evaluate(self, samples: DataFrame) -> DataFrame:
        return model_metrics(self.long_scores(samples))

    def summary(self) -> dict:
        return {
            "model_id": self.model_id,
            "training_seconds": self.training_seconds,
            "config": self.config.to_dict(),
            "n_features": self.trees.numFeatures,
            "n_trees": self.trees.getNumTrees,
        }

    def save(self, spark: SparkSession, path: str) -> None:
        self.features.write().overwrite().save(f"{path}/features")
        self.trees.write().overwrite().save(f"{path}/trees")
        note = {"model_id": self.model_id, "training_seconds": self.training_seconds, "config": self.config.to_dict()}
        spark.createDataFrame([(json.dumps(note),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/note")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FittedModel":
        note = json.loads(spark.read.text(f"{path}/note").first().value)
        return cls(
            note["model_id"],
            C.ModelConfig.from_dict(note["config"]),
            PipelineModel.load(f"{path}/features"),
            GBTClassificationModel.load(f"{path}/trees"),
            note["training_seconds"],
        )


@dataclass
class Grown:
    """Trees of one row of settings, as far as they were grown, and the validation loss after each of them."""

    trees: GBTClassificationModel
    losses: list[float]


@dataclass
class TrainingSet:
    """Vectors, weights and the validation mark, prepared once and shared by every fit. ``grown`` keeps what fits have grown, by settings."""

    features: PipelineModel
    rows: DataFrame
    one_class: bool
    grown: dict[tuple, Grown] = field(default_factory=dict)

    def release(self) -> None:
        self.rows.unpersist()
        self.grown.clear()


def prepare_training(samples: DataFrame, test_share: float = 0.2, weight_cap: float = 5.0) -> TrainingSet:
    filled = fill_missing(samples)
    balance = class_balance(filled, LABEL, weight_cap).first()
    one_class = balance.positives in (0, balance.total)
    features = feature_pipeline(filled).fit(filled)
    split = stratified_split(filled, LABEL, test_share, "cell_id", "target_date")
    weight = F.when(F.col(LABEL) > 0, F.lit(1.0 if one_class else float(balance.positive_weight))).otherwise(F.lit(1.0))
    rows = features.transform(split).select(
        F.col(LABEL).cast("double").alias(LABEL),
        "features",
        weight.alias("weight"),
        (F.col("is_test") == 1).alias("validation"),
    )
    tasks = max(LEAST_TASKS, math.ceil(balance.total / ROWS_PER_TASK))
    return TrainingSet(features, rows.coalesce(tasks).persist(), one_class)


def best_round(losses: list[float], patience: int) -> tuple[int, bool]:
    """The round (from 1) with the least loss before the first stretch of ``patience`` rounds without a lesser one, and whether there was
    such a stretch. Without a loss that is a number, the last round."""
    best, at = float("inf"), None
    for n, loss in enumerate(losses, 1):
        if loss < best:
            best, at = loss, n
        elif at is not None and n - at >= patience:
            return at, True
    return at or len(losses), False


def first_trees(grown: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The model after ``n`` rounds of boosting: its first n trees with their weights."""
    if n >= grown.getNumTrees:
        return grown
    gateway = SparkSession.active().sparkContext._gateway
    trees = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(gateway.jvm.double, n)
    whole = grown._java_obj
    for k, (tree, weight) in enumerate(zip(list(whole.trees())[:n], list(whole.treeWeights())[:n])):
        trees[k], weights[k] = tree, weight
    java = gateway.jvm.org.apache.spark.ml.classification.GBTClassificationModel(
        whole.uid(), trees, weights, whole.numFeatures(), whole.numClasses()
    )
    return grown._copyValues(GBTClassificationModel(java))


def settings_of(config: C.ModelConfig) -> tuple:
    """What decides the trees, whatever their number: fits with equal settings are prefixes of each other."""
    return config.max_depth, config.learning_rate, config.subsample, config.colsample, config.seed


def grow(training: TrainingSet, used: C.ModelConfig, seed: int, deadline: float = float("inf")) -> Grown:
    """Trees for ``used``, from those that are there already where that is enough.

    Rounds double until the loss has not improved for ``early_stopping_rounds`` of them, or all are grown. A longer fit repeats the shorter
    one tree by tree, so doubling costs at most twice the trees, while fits that stop early never grow the rest. After ``deadline`` (of
    ``time.monotonic``) rounds double no more.
    """
    key, patience = settings_of(used), used.early_stopping_rounds
    fitted = training.rows.filter("NOT validation")
    validation = training.rows.filter("validation")
    rounds = min(used.n_estimators, patience + patience // 4 + 1)
    while True:
        grown = training.grown.get(key)
        if grown is None or (grown.trees.getNumTrees < rounds and not best_round(grown.losses, patience)[1]):
            grower = GBTClassifier(
                labelCol=LABEL,
                featuresCol="features",
                weightCol="weight",
                maxDepth=used.max_depth,
                maxIter=rounds,
                stepSize=used.learning_rate,
                subsamplingRate=used.subsample,
                featureSubsetStrategy="all" if used.colsample >= 1.0 else str(used.colsample),
                maxBins=32,
                cacheNodeIds=False,
                seed=seed,
            )
            trees = grower.fit(fitted)
            grown = training.grown[key] = Grown(trees, list(trees.evaluateEachIteration(validation)))
        if rounds >= used.n_estimators or best_round(grown.losses[:rounds], patience)[1] or time.monotonic() >= deadline:
            return grown
        rounds = min(used.n_estimators, 2 * rounds)


def fit(training: TrainingSet, config: C.ModelConfig, model_id: str, deadline: float = float("inf")) -> FittedModel:
    """One boosted-tree model, cut at the round with the least validation loss.

    Of at most ``n_estimators`` rounds it keeps those up to the best one before the loss failed to improve for ``early_stopping_rounds``
    rounds. ``subsample`` and ``colsample`` map to row and feature sampling per tree. Spark's trees have no L1 or L2 term, so
    ``reg_alpha`` and ``reg_lambda`` are carried along but do not act.
    """
    started = time.perf_counter()
    used = PLAIN if training.one_class else config
    grown = grow(training, used, config.seed, deadline)
    best, _ = best_round(grown.losses[: used.n_estimators], used.early_stopping_rounds)
    return FittedModel(model_id, config, training.features, first_trees(grown.trees, best), time.perf_counter() - started)


def train(samples: DataFrame, config: C.ModelConfig | None = None, model_id: str = "base") -> FittedModel:
    training = prepare_training(samples)
    try:
        return fit(training, config or C.ModelConfig(), model_id)
    finally:
        training.release()
