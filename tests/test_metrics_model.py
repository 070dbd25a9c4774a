
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from conftest import rows
from emberline import config as C
from emberline.operators import metrics, model, profile, search
from emberline.plans.queries import tidy


def scores(spark, *triples):
    return spark.createDataFrame(list(triples), "model_id string, y int, p double")


SMALL = [("m", 1, 0.9), ("m", 0, 0.2), ("m", 1, 0.6), ("m", 0, 0.6)]


def test_metrics(spark):
    out = metrics.model_metrics(scores(spark, *SMALL)).first()
    assert out.log_loss == pytest.approx(0.438905, abs=1e-6)
    assert (out.roc_auc, out.recall, out.f1_score, out.fire_rate) == pytest.approx((0.875, 1.0, 0.8, 0.5))
    assert out.precision == pytest.approx(2 / 3)


def test_one_class_and_certain_scores(spark):
    out = metrics.model_metrics(scores(spark, ("a", 0, 0.0), ("a", 0, 0.4))).first()
    assert (out.roc_auc, out.precision, out.recall, out.f1_score) == (0.5, 0.0, 0.0, 0.0)
    assert metrics.model_metrics(scores(spark, ("b", 1, 0.0))).first().log_loss == pytest.approx(34.538776, abs=1e-4)


def test_area_equals_pair_count(spark):
    rng = random.Random(3)
    data = [("m", int(rng.random() < 0.3), round(rng.random(), 2)) for _ in range(400)]
    pos, neg = [p for _, y, p in data if y], [p for _, y, p in data if not y]
    won = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    assert metrics.ranked_area(scores(spark, *data)).first().roc_auc == pytest.approx(won / len(pos) / len(neg))


def test_fitness(spark):
    models = spark.createDataFrame([("m", 3.0), ("quick", None), ("lost", 0.1)], "model_id string, mean_seconds double")
    data = scores(spark, *SMALL, *[("quick", y, p) for _, y, p in SMALL])
    fitness = metrics.population_fitness(data, models)
    assert [r.model_id for r in metrics.leaderboard(fitness).collect()] == ["quick", "m", "lost"]
    found = {r.model_id: r.fitness for r in fitness.collect()}
    assert found["m"] - found["quick"] == pytest.approx(0.2) and found["lost"] == float("inf")
    assert metrics.leaderboard(fitness, 2).count() == 2
    assert metrics.fitness_summary(fitness).first().worst == float("inf")


def test_history(spark):
    values = [0.5, 0.41231, 0.6, 0.41229]
    df = spark.createDataFrame(list(enumerate(values)), "generation int, fitness double")
    out = metrics.convergence(metrics.best_history(df)).orderBy("generation").collect()
    assert [r.best_fitness for r in out] == [0.5, 0.41231, 0.41231, 0.41229]
    assert [r.converged for r in out] == [0, 0, 0, 1]
    assert search.converged([0.5, 0.41231, 0.41229, 0.41229], 3) and not search.converged([0.5, 0.4123, 0.4123], 3)


def test_baseline(spark):
    samples = spark.createDataFrame(
        [(1, "forest", 1), (2, "forest", 0), (3, "land", 1), (3, "forest", 0)], "cell_id long, terrain_type string, fire_occurred int"
    )
    asked = spark.createDataFrame([(3, "2023-06-01"), (7, "2023-09-01")], "cell_id long, target_date string").withColumn(
        "target_date", F.col("target_date").cast("date")
    )
    found = {r.cell_id: r.fire_probability for r in metrics.baseline_scores(asked, samples).collect()}
    assert found[3] == pytest.approx(0.5) and found[7] == pytest.approx(1.3 / 3)
    no_forest = samples.filter("terrain_type = 'land'")
    assert {r.fire_probability for r in metrics.baseline_scores(asked, no_forest).collect()} == {0.95}


def test_profiles(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (3.0, 5.0, None)], "a double, b double, c double")
    out = {r.feature: r for r in profile.feature_profile(df, "a", "b", "c").collect()}
    assert (out["a"].mean, out["a"].constant, out["b"].constant, out["c"].constant, out["c"].nulls) == (2.0, 0, 1, 1, 2)
    assert out["a"].std == pytest.approx(2**0.5)
    assert rows(profile.non_null_counts(df)) == [("a", 2, 0), ("b", 2, 0), ("c", 0, 2)]
    assert rows(profile.range_profile(df, "a")) == [("a", 1.0, 3.0)]
    labels = spark.createDataFrame([(1,)] * 10 + [(0,)] * 90, "fire_occurred int")
    balance = profile.class_balance(labels).first()
    assert (balance.positives, balance.fire_rate, balance.balance, balance.positive_weight) == (10, 0.1, "ok", 5.0)
    assert profile.class_balance(labels.filter("fire_occurred = 0")).first().positive_weight == 1.0


def sample_rows(spark, n=300, one_class=False):
    rng = random.Random(11)
    data = []
    for i in range(n):
        heat = rng.uniform(-10, 35)
        fire = 0 if one_class else int(heat + rng.uniform(-5, 5) > 25)
        data.append((i, f"2023-07-{1 + i % 28:02d}", ("forest", "land", "urban")[i % 3], fire, heat, None if i % 9 == 0 else rng.random()))
    df = spark.createDataFrame(
        data, "cell_id long, target_date string, terrain_type string, fire_occurred int, year_1_max_temp double, avg_temp_trend double"
    )
    return df.withColumn("target_date", F.col("target_date").cast("date")).persist()


def test_model_round_trip(spark, tmp_path):
    samples = sample_rows(spark)
    fitted = model.train(samples, C.ModelConfig(max_depth=3, n_estimators=5), "first")
    scored = fitted.score(samples)
    assert scored.count() == 300
    assert scored.filter("fire_probability BETWEEN 0 AND 1").count() == 300
    result = fitted.evaluate(samples).first()
    assert result.roc_auc > 0.9 and result.log_loss < 0.5
    fitted.save(spark, str(tmp_path / "model"))
    again = model.FittedModel.load(spark, str(tmp_path / "model"))
    assert rows(tidy(again.score(samples))) == rows(tidy(scored))
    assert again.config == fitted.config and again.summary()["n_features"] == 3
    unknown = samples.withColumn("terrain_type", F.lit("moon"))
    assert fitted.score(unknown).count() == 300


def test_best_round():
    assert model.best_round([5, 4, 3, 3.5, 3.2, 2, 9], 2) == (3, True)
    assert model.best_round([5, 4, 3, 3.5, 3.2, 2, 9], 3) == (6, False)
    assert model.best_round([3, 4, 5], 1) == (1, True) and model.best_round([3, 2, 1], 1) == (3, False)
    assert model.best_round([float("nan")] * 4, 2) == (4, False)


def test_trees_follow_rounds_and_patience(spark):
    training = model.prepare_training(sample_rows(spark))
    config = C.ModelConfig(max_depth=2, n_estimators=12, learning_rate=0.3, early_stopping_rounds=3)
    few = model.fit(training, config, "few")
    grown = training.grown[model.settings_of(config)]
    best, stopped = model.best_round(grown.losses, 3)
    assert few.trees.getNumTrees == best and (stopped or grown.trees.getNumTrees == 12)
    # With more patience at least as many rounds; all rounds where patience never ends.
    patient = C.ModelConfig(max_depth=2, n_estimators=12, learning_rate=0.3, early_stopping_rounds=50)
    whole = model.fit(training, patient, "whole")
    grown = training.grown[model.settings_of(patient)]
    assert grown.trees.getNumTrees == 12 and whole.trees.getNumTrees == min(range(12), key=lambda n: grown.losses[n]) + 1
    # Fewer rounds are a cut of the same fit, and score like a fit of their own.
    before = dict(training.grown)
    short = model.fit(training, C.ModelConfig(max_depth=2, n_estimators=4, learning_rate=0.3, early_stopping_rounds=50), "short")
    assert all(training.grown[k] is before[k] for k in before) and short.trees.getNumTrees <= 4
    alone = model.fit(model.prepare_training(sample_rows(spark)), short.config, "short")
    samples = sample_rows(spark)
    assert rows(tidy(short.score(samples))) == rows(tidy(alone.score(samples)))


def test_search_ends_by_time(spark):
    samples = sample_rows(spark, 100)
    found = search.search(samples, samples, C.SearchConfig(population_size=3, max_seconds=0.0))
    assert found.ended == "time" and found.history == [] and found.history_table(spark).count() == 0
    one = dict(C.SEARCH_SPACE, n_estimators=(2, 2, 1, True), max_depth=(2, 2, 1, True))
    settings = C.SearchConfig(population_size=12, max_generations=3, parallel_fits=1, max_seconds=0.5, elite_count=2, default_members=1)
    found = search.search(samples, samples, settings, one)
    last = found.history_table(spark).collect()[-1]
    assert last.ended == "time" and last.n_fitted + last.n_missing == 12 and last.n_missing > 0


def test_candidates_share_fits(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(search, "fit", lambda training, config, name, deadline: asked.append((name, config.n_estimators)) or SimpleNamespace(model_id=name))
    same = {f"m{n}": C.ModelConfig(n_estimators=n) for n in (50, 200, 100)}
    found = search.fit_all({**same, "other": C.ModelConfig(max_depth=9)}, None, 1)
    assert set(found) == {"m50", "m100", "m200", "other"} and [n for n, _ in asked if n != "other"] == ["m200", "m100", "m50"]


def test_single_class_uses_the_plain_model(spark):
    fitted = model.train(sample_rows(spark, 60, one_class=True), C.ModelConfig(n_estimators=50), "flat")
    assert fitted.trees.getNumTrees <= 10
    assert fitted.evaluate(sample_rows(spark, 60, one_class=True)).first().roc_auc == 0.5


def test_candidates(spark):
    first = search.first_candidates(spark)
    rows = first.orderBy("slot").collect()
    base = C.ModelConfig()
    assert len(rows) == 50 and len({r.model_id for r in rows}) == 50
    assert sum(all(r[n] == getattr(base, n) for n in C.SEARCH_SPACE) for r in rows) == 5
    ranked = first.withColumn("fitness", F.col("slot").cast("double"))
    for generation in range(1, 5):
        following = search.next_candidates(ranked, generation)
        found = following.orderBy("slot").collect()
        assert len(found) == 50 and [r.model_id for r in found[:5]] == [r.model_id for r in ranked.orderBy("fitness").limit(5).collect()]
        for r in found:
            for name, (low, high, _, whole) in C.SEARCH_SPACE.items():
                assert low <= r[name] <= high and (not whole or r[name] == int(r[name]))
        assert len({tuple(r[n] for n in C.SEARCH_SPACE) for r in found}) > 10
        ranked = spark.createDataFrame(found, following.schema).withColumn("fitness", F.col("slot") / 7)
    again = search.next_candidates(first.withColumn("fitness", F.col("slot").cast("double")).repartition(3), 1).orderBy("slot").collect()
    assert again == search.next_candidates(first.withColumn("fitness", F.col("slot").cast("double")), 1).orderBy("slot").collect()
    config = search.config_of(rows[7])
    assert isinstance(config.max_depth, int) and C.ModelConfig.from_dict(config.to_dict()) == config
    few = search.next_candidates(ranked.limit(2), 9).collect()
    assert len(few) == 50


def test_search(spark, tmp_path):
    samples = sample_rows(spark, 200)
    space = dict(C.SEARCH_SPACE, n_estimators=(2, 4, 1, True), max_depth=(2, 3, 1, True))
    settings = C.SearchConfig(population_size=3, max_generations=3, elite_count=2, default_members=1, test_samples_per_generation=50)
    result = search.search(samples, samples, settings, space)
    history = result.history_table(spark).orderBy("generation").collect()
    assert 1 <= len(history) <= 3 and history[0].n_fitted == 3 and all(h.n_fitted == 1 for h in history[1:])
    best = [h.best_fitness for h in history]
    assert best == sorted(best, reverse=True)
    summary = result.summary(spark).first()
    assert summary.generations == len(history) and summary.fitness_history == best
    assert result.best.trees is not None
    result.write_summary(spark, str(tmp_path / "summary"))
    assert spark.read.json(str(tmp_path / "summary")).first().best_model_id == result.best.model_id


def test_registered_search_takes_the_default_settings(spark, monkeypatch):
    from types import SimpleNamespace

    from emberline.plans import queries

    asked = []

    def noted(train, test, settings=C.SearchConfig(), space=C.SEARCH_SPACE):
        asked.append((settings, space))
        return SimpleNamespace(history_table=lambda s: s.createDataFrame([(0, 1.0)], "generation int, seconds double"))

    monkeypatch.setattr(queries, "workspace", lambda s, d: SimpleNamespace(samples=lambda kind: s.range(1).toDF("cell_id")))
    monkeypatch.setattr(search, "search", noted)
    assert queries.search_history(spark, "").columns == ["generation"]
    assert asked == [(C.SearchConfig(max_seconds=queries.SEARCH_SECONDS), C.SEARCH_SPACE)]


def test_registered_search_fits_every_candidate(spark, monkeypatch):
    from itertools import count

    from emberline.plans import queries

    # Every look at the clock is two hours later.
    clock, fitted = count(0.0, 7200.0), []
    monkeypatch.setattr(search, "time", SimpleNamespace(monotonic=lambda: next(clock), perf_counter=lambda: 0.0))
    monkeypatch.setattr(search, "fit", lambda training, config, name, deadline: fitted.append(name) or SimpleNamespace(model_id=name))

    def ratings(models, asked):
        # Each generation is better than those before it, so the search does not converge.
        return spark.createDataFrame([(m.model_id, 1.0 / (1 + len(fitted)) + int(m.model_id.split("-")[1]) / 1e6) for m in models], "model_id string, fitness double")

    monkeypatch.setattr(search, "rated", ratings)
    monkeypatch.setattr(queries, "workspace", lambda s, d: SimpleNamespace(samples=lambda kind: sample_rows(s, 40)))
    history = queries.search_history(spark, "").orderBy("generation").collect()
    whole = C.SearchConfig()
    assert [(r.generation, r.n_missing, r.ended) for r in history] == [
        (g, 0, "generations" if g == whole.max_generations - 1 else None) for g in range(whole.max_generations)
    ]
    assert [r.n_fitted for r in history] == [whole.population_size] + [whole.population_size - whole.elite_count] * (whole.max_generations - 1)
    assert len(fitted) == sum(r.n_fitted for r in history) == len(set(fitted))


def test_training_rows_have_tasks_by_their_number(spark):
    training = model.prepare_training(sample_rows(spark).repartition(40))
    assert training.rows.rdd.getNumPartitions() == model.LEAST_TASKS and training.rows.count() == sample_rows(spark).count()
    training.release()
