"""Queries: feature assembly, classifier and text models. Where a query passes `SMALL`, its models are small; the settings are parameters."""

import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from editlens import schema as S
from editlens.checks.fixtures import FRAGMENT_SCORES, Tables
from editlens.checks.registry import query
from editlens.models import classifier as C
from editlens.models import text_scorer as TS
from editlens.operators import edit_features as EF, fragments as Fr, metrics as M, revisions as R, slices as Sl
from editlens.session import work_path

ID, WIKI, LABEL = S.ID, S.WIKI, S.LABEL
R6 = lambda c, name=None: F.round(c, 6).alias(name or c)
SMALL = C.TrainingSettings(rounds=5, depth=3)
META_DAYS = {"train_days": (1, 15), "test_days": (16, 31)}

BASIC = [WIKI]
REVISION = ["page_revision_count", "revision_text_bytes_diff"]
FLAGS = ["is_mobile_edit", "is_mobile_web_edit", "is_visualeditor", "is_wikieditor", "is_ios_app_edit"]
REGION = ["country"]
TEXT = ["insert_p_1_mean", "change_p_1_mean"]
CATEGORICAL = [WIKI, *FLAGS, *REGION, S.ANONYMOUS]
FEATURES = [*BASIC, *REVISION, *FLAGS, S.ANONYMOUS]


def _training_rows(t: Tables):
    rows = R.flag_tags(t.history.withColumn(LABEL, F.col(LABEL).cast("int")))
    return rows.withColumns({"insert_p_1_mean": F.col("incumbent_pred"), "change_p_1_mean": F.col("linear_pred")})


def _full_features(t: Tables):
    """History rows with every classifier input."""
    rows = R.flag_tags(t.history).drop(S.ANONYMOUS)
    rows = rows.join(R.flag_user_groups(t.history), S.KEYS)
    counts = F.create_map(
        F.lit("insert_Text"), (F.col(ID) % 7).cast("int"), F.lit("move_Table Element"), (F.col(ID) % 3).cast("int")
    )
    rows = R.expand_actions(rows.withColumn("actions", counts))
    scores = {c: F.when(F.col(ID) % 2 == 0, F.col("linear_pred")) for c in [*S.TEXT_FEATURES, "title_s_0"]}
    return R.rename_features(rows.withColumns(scores))


def _feature_sql() -> str:
    columns = []
    for name in S.feature_list():
        tag = dict(zip(S.TAG_FLAGS, S.EDIT_TAGS)).get(name)
        group = dict(zip(S.GROUP_FLAGS, S.USER_GROUPS)).get(name)
        if tag:
            value = f"CAST(coalesce(list_contains(revision_tags, '{tag}'), false) AS INT)"
        elif group:
            value = f"CAST(coalesce(list_contains(event_user_groups, '{group}'), false) AS INT)"
        elif name == S.ANONYMOUS:
            value = "CAST(is_anonymous AS INT)"
        elif name.startswith("bert_"):
            value = "round(CASE WHEN revision_id % 2 = 0 THEN linear_pred ELSE -1 END, 6)"
        elif name in S.ACTION_FEATURES:
            value = {"insert_Text": "CAST(revision_id % 7 AS INT)", "move_Table Element": "CAST(revision_id % 3 AS INT)"}.get(name, "0")
        else:
            value = name
        columns.append(f'{value} AS "{name}"')
    return f"SELECT revision_id, {', '.join(columns)} FROM history"


@query(_feature_sql())
def feature_list(t: Tables):
    names = S.feature_list()
    rows = R.fill_missing_features(_full_features(t), names)
    return rows.select(ID, *[R6(c) if c.startswith("bert_") else F.col(f"`{c}`") for c in names])


def _vector_sql() -> str:
    """Sum of the vector: numbers as they are, categories by falling count and then by name, from 0."""
    names = S.feature_list()
    cats = [c for c in names if c in S.CATEGORICAL_FEATURES]
    filled = ", ".join(f"""coalesce("{c}", {"'-1'" if c == WIKI else -1}) AS "{c}\"""" for c in names)
    counts = ", ".join(f'count(*) OVER (PARTITION BY "{c}") AS "n_{c}"' for c in cats)
    places = [f'dense_rank() OVER (ORDER BY "n_{c}" DESC, CAST("{c}" AS VARCHAR)) - 1' for c in cats]
    total = " + ".join([f'CAST("{c}" AS DOUBLE)' for c in names if c not in cats] + places)
    rows = _feature_sql().replace("SELECT revision_id", f"SELECT {WIKI} AS wiki, revision_id", 1)
    return f"""WITH f AS ({rows}), filled AS (SELECT revision_id, {filled} FROM f), counted AS (SELECT *, {counts} FROM filled)
SELECT revision_id, {len(names)} AS width, round({total}, 6) AS total FROM counted""".replace(f"SELECT {WIKI} AS wiki, ", "SELECT ")


@query(_vector_sql())
def assemble_features(t: Tables):
    names = S.feature_list()
    rows = C.assemble_features(_full_features(t), names)
    vector = vector_to_array("features")
    return rows.select(ID, F.size(vector).alias("width"), F.round(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query()
def train_classifier(t: Tables):
    rows = _training_rows(t)
    _, scored = C.train_and_test(rows, FEATURES, CATEGORICAL)
    return M.metric_table(scored, [], score="predict_score").select("n", "auc", "log_loss", "accuracy", "f1")


@query()
def predict_scores(t: Tables):
    rows = _training_rows(t)
    model = C.train_classifier(rows.where(F.dayofmonth(S.TIMESTAMP) < 15), FEATURES, CATEGORICAL, settings=SMALL)
    return C.predict_scores(model, rows.where(F.dayofmonth(S.TIMESTAMP) >= 15), FEATURES).select(*S.KEYS, "predict_score")


@query()
def feature_importance(t: Tables):
    model = C.train_classifier(_training_rows(t), FEATURES, CATEGORICAL, settings=SMALL)
    return C.feature_importance(model, FEATURES)


@query()
def save_load_model(t: Tables):
    rows = _training_rows(t)
    path = work_path(t.spark, "model")
    C.save_model(C.train_classifier(rows, FEATURES, CATEGORICAL, settings=SMALL), path)
    return C.predict_scores(C.load_model(path), rows, FEATURES).select(*S.KEYS, "predict_score")


# What any model must keep, against SQL: rows, the range of its scores, a least AUC on rows it has not seen.
LATE = "dayofmonth(event_timestamp) >= 15"
_TESTED = f"SELECT CAST(sum(ceil(n * CAST(0.1 AS DOUBLE))) AS BIGINT) AS n, true AS in_range, true AS good FROM (SELECT {LABEL}, count(*) AS n FROM history WHERE {LABEL} IS NOT NULL GROUP BY ALL)"


def _kept(scored, least_auc: float):
    in_range = scored.agg(F.coalesce(F.min(F.col("predict_score").between(0, 1)), F.lit(False)).alias("in_range"))
    quality = M.metric_table(scored, [], score="predict_score").select("n", (F.col("auc") >= least_auc).alias("good"))
    return quality.withColumn("in_range", in_range.scalar())


@query(_TESTED)
def train_classifier_kept(t: Tables):
    _, scored = C.train_and_test(_training_rows(t), FEATURES, CATEGORICAL, settings=SMALL)
    return _kept(scored, 0.9)


@query(_TESTED)
def train_classifier_default_settings(t: Tables):
    """100 rounds of depth 6."""
    _, scored = C.train_and_test(_training_rows(t), FEATURES, CATEGORICAL)
    return _kept(scored, 0.9)


@query(f"SELECT revision_id, wiki_db, true AS in_range FROM history WHERE {LATE}")
def predict_scores_kept(t: Tables):
    return predict_scores(t).select(*S.KEYS, F.col("predict_score").between(0, 1).alias("in_range"))


@query("SELECT unnest([{}]) AS feature_name, true AS in_range, CAST(1 AS DOUBLE) AS total".format(", ".join(f"'{c}'" for c in FEATURES)))
def feature_importance_kept(t: Tables):
    rows = feature_importance(t)
    total = rows.agg(F.round(F.sum("feature_importance"), 6)).scalar()
    return rows.select("feature_name", F.col("feature_importance").between(0, 1).alias("in_range"), total.alias("total"))


@query("SELECT revision_id, wiki_db, true AS same FROM history")
def save_load_model_kept(t: Tables):
    """A model read back gives the scores of the one that was written."""
    rows, path = _training_rows(t), work_path(t.spark, "model")
    model = C.train_classifier(rows, FEATURES, CATEGORICAL, settings=SMALL)
    C.save_model(model, path)
    both = C.predict_scores(model, rows, FEATURES).withColumnRenamed("predict_score", "__first")
    return C.predict_scores(C.load_model(path), both, FEATURES).select(*S.KEYS, (F.col("predict_score") == F.col("__first")).alias("same"))


@query()
def feature_set_ablation(t: Tables):
    rows = _training_rows(t)
    sets = {
        "all": [*BASIC, *REVISION, *FLAGS, *REGION, *TEXT],
        "no_text_features": [*BASIC, *REVISION, *FLAGS, *REGION],
        "no_user_and_page_location_features": [*BASIC, *REVISION, *FLAGS, *TEXT],
        "features_text_only": TEXT,
    }
    early = F.dayofmonth(S.TIMESTAMP) < 15
    return C.feature_set_ablation(rows.where(early), rows.where(~early), sets, CATEGORICAL)


def _compared(scored):
    models = {"boosted_pred": "boosted", "linear_pred": "linear", "incumbent_pred": "incumbent", "meta_pred": "meta"}
    from editlens.operators.joins import unpivot_scores

    return Sl.metrics_by_group(unpivot_scores(scored, [LABEL], models), [])


@query()
def meta_model_reduced(t: Tables):
    rows = R.filter_scored(_training_rows(t), ["incumbent_pred"])
    scored = C.meta_model(rows, FEATURES, ["boosted_pred", "linear_pred"], (), CATEGORICAL, settings=SMALL, **META_DAYS)
    return _compared(scored)


@query()
def meta_model_full(t: Tables):
    rows = R.filter_scored(_training_rows(t), ["incumbent_pred"])
    extra = EF.edit_features(t.history, t.content)
    widened = R.drop_incomplete(rows, extra, S.KEYS, ["user_groups"])
    flags = ["has_comment", "user_is_anonymous", "user_groups"]
    scored = C.meta_model(
        widened, FEATURES, ["boosted_pred", "linear_pred"], S.EXTRA_FEATURES, [*CATEGORICAL, *flags], settings=SMALL, **META_DAYS
    )
    return _compared(scored)


def _labelled_documents(t: Tables):
    labels = t.table("labels").select("doc_id", F.col("quality").alias("label"))
    docs = t.table("documents").join(labels, "doc_id")
    return docs.select(F.col("doc_id").alias(ID), "text", F.lit(None).cast("string").alias("text_pair"), "label")


@query()
def train_text_scorer(t: Tables):
    _, quality = TS.hold_out_quality(_labelled_documents(t), [ID], share=0.2, width=1 << 14, rounds=10)
    return quality


@query()
def train_title_scorer(t: Tables):
    titles = Fr.title_training_set(t.history).withColumnRenamed("page_title", "text")
    _, quality = TS.hold_out_quality(titles, ["text"], regression=True, share=0.2, width=1 << 10, rounds=10)
    return quality


@query()
def score_texts(t: Tables):
    model = TS.train_text_scorer(_labelled_documents(t), width=1 << 14, rounds=10)
    fragments = Fr.collect_fragments(t.edits, "insert")
    return Fr.softmax_scores(TS.score_texts(model, fragments)).select("text", "s_0", "s_1", "p_0", "p_1")


def _length_scorer(frame: pd.DataFrame) -> pd.DataFrame:
    length = frame["text"].str.len()
    return pd.DataFrame({"s_0": (length % 17) / 8 - 1, "s_1": 1 - (length % 23) / 11})


@query(f"""SELECT text, round({FRAGMENT_SCORES['s_0']}, 6) AS s_0, round({FRAGMENT_SCORES['s_1']}, 6) AS s_1
FROM (SELECT DISTINCT unnest(texts_insert) AS text FROM edits) WHERE length(text) > 0""")
def score_fragments(t: Tables):
    scored = Fr.score_fragments(Fr.collect_fragments(t.edits, "insert"), _length_scorer)
    return scored.select("text", R6("s_0"), R6("s_1"))
