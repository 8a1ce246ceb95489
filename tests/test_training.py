"""How rows are dealt in training (by their number), and how many rounds are trained (all) and kept (up to the best)."""

from collections import Counter
from dataclasses import replace

import pytest
from compare import rows_of
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from editlens import schema as S
from editlens.checks import train as T
from editlens.models import classifier as C

ROWS = 40_000


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    """One class has nine tenths of the rows; keys repeat, and many are null."""
    path = str(tmp_path_factory.mktemp("training") / "rows")
    spark.range(ROWS).select(
        F.when(F.col("id") % 2 == 0, F.col("id") % 5).alias("revision_id"), F.lit("enwiki").alias("wiki_db"),
        (F.col("id") % 10 == 0).cast("int").alias("label"), (F.col("id") % 7 + F.col("id") % 10).cast("double").alias("x"),
    ).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def test_trees_get_rows_dealt_by_their_number(rows, monkeypatch):
    seen = {}

    def fit(assembled, bins, settings):
        seen["sizes"] = assembled.select("x").rdd.glom().map(len).collect()
        return fit_trees(assembled, bins, settings)

    fit_trees = C._fit_trees
    monkeypatch.setattr(C, "_fit_trees", fit)
    monkeypatch.setattr(C, "MOST_VALUES", 5000, raising=False)
    C.train_classifier(rows, ["x"], [], "label", C.TrainingSettings(rounds=1, depth=1))
    assert sum(seen["sizes"]) == ROWS and len(seen["sizes"]) >= 8 and max(seen["sizes"]) < 8000


@pytest.fixture(scope="module")
def noisy(spark, tmp_path_factory):
    """Labels that the features explain in part, so that the loss of unseen rows falls slowly and rises again."""
    path = str(tmp_path_factory.mktemp("training") / "noisy")
    some = lambda i: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000
    rows = spark.range(3000).select("id", *[some(i).alias(f"x{i}") for i in range(4)], some(9).alias("luck"))
    likely = 1 / (1 + F.exp(1 - 2 * F.sin(F.col("x0") * 4) - 3 * F.col("x1") * F.col("x2")))
    rows = rows.select(
        F.col("id").alias("revision_id"), F.when(F.col("id") % 3 == 0, "enwiki").otherwise("dewiki").alias("wiki_db"),
        "x0", "x1", "x2", "x3", (F.col("luck") < likely).cast("int").alias("label"), (F.col("id") % 2).cast("int").alias("is_balanced"),
    )
    rows.coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def test_all_rounds_are_trained_and_kept_up_to_the_best(noisy, monkeypatch, tmp_path):
    names, settings, seen = ["x0", "x1", "x2", "x3"], C.TrainingSettings(rounds=30, depth=3), {}

    def fit(assembled, bins, settings):
        seen.update(rows=assembled, bins=bins)
        return fit_trees(assembled, bins, settings)

    fit_trees = C._fit_trees
    monkeypatch.setattr(C, "_fit_trees", fit)
    model = C.train_classifier(noisy, names, [], "label", settings)
    every = GBTClassifier(
        labelCol="__label", featuresCol="features", weightCol="__weight", maxIter=30, stepSize=0.1, maxDepth=3, maxBins=seen["bins"], seed=settings.seed
    ).fit(seen["rows"].where("not __held_out"))
    losses = every.evaluateEachIteration(seen["rows"].where("__held_out"))
    trees, best = model.stages[-1], losses.index(min(losses)) + 1
    assert every.getNumTrees == 30 and 5 < best < 30
    assert trees.getNumTrees == best and trees.treeWeights == every.treeWeights[:best]
    assert [t.toDebugString.split("\n")[1:] for t in trees.trees] == [t.toDebugString.split("\n")[1:] for t in every.trees[:best]]
    assert trees.numFeatures == 4 and len(trees.featureImportances) == 4
    C.save_model(model, str(tmp_path / "m"))
    scores = [C.predict_scores(m, noisy, names).select(*S.KEYS, "predict_score") for m in (model, C.load_model(str(tmp_path / "m")))]
    assert scores[0].exceptAll(scores[1]).count() == 0


@pytest.mark.parametrize("name, models", [("train_classifier", 1), ("feature_set_ablation", 4)])
def test_queries_train_models_of_full_size(spark, monkeypatch, name, models):
    asked = []

    def fit(assembled, bins, settings):
        asked.append((settings.rounds, settings.step, settings.depth, settings.bins))
        return fit_trees(assembled, bins, replace(settings, rounds=1, depth=1))

    fit_trees = C._fit_trees
    rows = spark.range(600).select(
        F.col("id").alias(S.ID), F.lit("enwiki").alias(S.WIKI), F.timestamp_seconds(F.col("id") * 3600).alias(S.TIMESTAMP),
        (F.col("id") % 3 == 0).cast("int").alias(S.LABEL), (F.col("id") % 2).cast("int").alias("is_balanced"), F.lit("C1").alias("country"),
        *[(F.col("id") % (5 + i)).alias(c) for i, c in enumerate([*T.REVISION, *T.FLAGS, S.ANONYMOUS, *T.TEXT])],
    )
    monkeypatch.setattr(C, "_fit_trees", fit)
    monkeypatch.setattr(T, "_training_rows", lambda t: rows)
    assert getattr(T, name)(None).count() > 0
    assert asked == [(100, 0.1, 6, 128)] * models


def test_sets_trained_side_by_side_give_what_they_give_alone(noisy, monkeypatch):
    sets, settings = {"wave": ["x0"], "product": ["x1", "x2", S.WIKI], "nothing": ["x3"]}, C.TrainingSettings(rounds=2, depth=2)
    early = F.col(S.ID) < 2000
    found = lambda s: C.feature_set_ablation(noisy.where(early), noisy.where(~early), s, [S.WIKI], "label", settings)
    got, alone = found(sets), [found({name: features}) for name, features in sets.items()]
    monkeypatch.setattr(C, "_tasks", lambda rows, n_rows, width: 8 if width == 3 else 1)
    by_turns = found(sets)

    def rows_in(*frames):
        return sum((rows_of(f.columns, [tuple(r) for r in f.collect()])[0] for f in frames), Counter())

    assert rows_in(got) == rows_in(*alone) == rows_in(by_turns)
    assert got.where("scope = 'all' and part = 'full'").count() == 3
