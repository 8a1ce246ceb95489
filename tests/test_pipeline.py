"""The whole way from history to result tables on the smallest tables."""

import pytest
from pyspark.sql import functions as F

from editlens import schema as S
from editlens.checks.fixtures import Tables
from editlens.models import classifier as C
from editlens.operators.revisions import flag_user_groups, rename_features
from editlens.operators.joins import lookup_user_features
from editlens.plans import collection, evaluation, features, preparation, training
from editlens.session import materialize

FOLDER = "/root/testdata/sf0.001"
SETTINGS = collection.CollectionSettings(start="2024-01-01", end="2024-02-01", max_rows_per_wiki=150)


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, FOLDER)


@pytest.fixture(scope="module")
def wikitext(tables):
    docs = tables.table("documents").select("doc_id", F.col("text"))
    n = docs.count()
    revisions = tables.history.select(*S.KEYS, ((F.floor((F.col(S.ID) - 1) / 9)) % n).alias("doc_id"))
    # A revision and its parent (9 ids before) share most text; every second one has a line more, all differ in one.
    extra = F.when(F.col(S.ID) % 2 == 0, F.concat(F.lit("\nwholly fresh words "), S.ID)).otherwise("")
    line = F.concat(F.lit("\na stable line that counts "), S.ID, F.lit(" and links [[page "), F.col(S.ID) % 5, F.lit("]]"))
    return revisions.join(docs, "doc_id").select(
        *S.KEYS, F.lit("2022-11").alias("snapshot"), F.lit(0).alias("page_namespace"),
        F.concat(F.lit("Opening"), line, extra).alias("revision_text"),
    )


@pytest.fixture(scope="module")
def collected(tables, wikitext):
    return materialize(collection.collect(tables.history, wikitext, SETTINGS), "collected")


def test_collection(tables, collected):
    assert collected.count() > 300
    assert collected.select(*S.KEYS).distinct().count() == collected.count()
    assert set(S.COLLECTED_COLUMNS) <= set(collected.columns)
    assert collected.groupBy(S.WIKI).count().agg(F.max("count")).first()[0] <= 150
    wanted = collection.filtered_revisions(tables.history, SETTINGS)
    assert collected.join(wanted, S.KEYS, "left_anti").count() == 0
    assert collected.where(F.size("texts_insert") + F.size("texts_removed") + F.size("texts_change") > 0).count() > 300
    assert collected.where(F.size("actions") > 0).count() > 300


def test_training_and_evaluation(spark, tables, collected):
    train, test = preparation.train_and_test(collected, "2024-01-21")
    train, test = materialize(train, "train"), materialize(test, "test")
    assert train.count() + test.count() == collected.where(f"not coalesce({S.REVERTER_REVERTED}, false)").count()
    models = features.train_text_models(train, width=1 << 8, rounds=2)
    users = flag_user_groups(tables.history)
    built = [
        materialize(rename_features(lookup_user_features(features.build_features(part, models), users)), "features")
        for part in (train.where("is_text_train = 0"), test)
    ]
    assert [b.count() for b in built] == [train.where("is_text_train = 0").count(), test.count()]
    names = S.feature_list()
    model = C.train_classifier(built[0], names, settings=C.TrainingSettings(rounds=2, depth=2))
    scored = C.predict_scores(model, built[1], names).withColumnsRenamed({"predict_score": "ours"})
    scored = scored.withColumn("reference", F.when(F.col(S.ID) % 7 != 0, (F.col(S.ID) % 100) / 100.0))
    assert scored.where("ours between 0 and 1").count() == test.count()
    out = evaluation.evaluate(scored, {"ours": "ours", "reference": "reference"}, "reference", min_rows=5)
    assert {r["model"] for r in out["leaderboard"].collect()} == {"ours", "reference", "baseline"}
    assert out["by_wiki"].count() > 0 and out["by_day"].count() > 0
    base = out["fairness"].where("model = 'baseline'").first()
    assert base["disparate_impact"] is None


def test_loaded_model_predicts_the_same(spark, tables, tmp_path):
    rows = tables.history.select(*S.KEYS, S.LABEL, "page_revision_count", "user_id")
    names = [S.WIKI, "page_revision_count", "user_id"]
    model = C.train_classifier(rows, names, settings=C.TrainingSettings(rounds=2, depth=2))
    C.save_model(model, str(tmp_path / "m"))
    a = C.predict_scores(model, rows, names).select(*S.KEYS, "predict_score")
    b = C.predict_scores(C.load_model(str(tmp_path / "m")), rows, names).select(*S.KEYS, "predict_score")
    assert a.exceptAll(b).count() == 0


def test_unknown_category_is_scored(spark, tables):
    rows = tables.history.select(*S.KEYS, S.LABEL, "user_id")
    model = C.train_classifier(rows, [S.WIKI, "user_id"], settings=C.TrainingSettings(rounds=1, depth=2))
    other = rows.withColumn(S.WIKI, F.lit("xxwiki"))
    assert C.predict_scores(model, other, [S.WIKI, "user_id"]).where("predict_score is null").count() == 0


def test_one_job_from_collected_rows_to_written_scores(spark, tables, collected, tmp_path):
    path = str(tmp_path / "scores")
    small = training.JobSettings("2024-01-21", 1 << 8, 2, C.TrainingSettings(rounds=2, depth=2))
    _, scored = training.train_and_score(collected, flag_user_groups(tables.history), path, small)
    _, test = preparation.train_and_test(collected, "2024-01-21")
    assert scored.count() == test.count() == spark.read.parquet(path).count() > 0
    assert scored.where("predict_score between 0 and 1").count() == test.count()
    out = evaluation.evaluate(scored.withColumn("reference", F.lit(0.5)), {"predict_score": "ours", "reference": "reference"}, "reference")
    assert {r["model"] for r in out["leaderboard"].collect()} == {"ours", "reference", "baseline"}
