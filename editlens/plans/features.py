"""Feature job: text models on the text split, their scores and action counts as columns."""

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editlens.models.text_scorer import score_texts, train_text_scorer
from editlens.operators import fragments as Fr
from editlens.operators.revisions import expand_actions, filter_split, normalize_title


def train_text_models(train: DataFrame, width: int = 1 << 18, rounds: int = 20) -> dict[str, PipelineModel]:
    """One text model per kind, trained on the text side of the title split."""
    rows = filter_split(train, text_train=True)
    models = {}
    for kind in ("insert", "change", "remove"):
        data = Fr.text_training_set(rows, kind).withColumnsRenamed({"sentence1": "text", "sentence2": "text_pair"})
        models[kind] = train_text_scorer(data, pair=kind == "change", width=width, rounds=rounds)
    titles = Fr.title_training_set(rows).withColumnRenamed("page_title", "text")
    models["title"] = train_text_scorer(titles, regression=True, width=width, rounds=rounds)
    return models


def fragment_scores(df: DataFrame, kind: str, model: PipelineModel) -> DataFrame:
    """Scores of the distinct fragments of a kind."""
    return score_texts(model, Fr.collect_fragments(df, kind), pair=kind == "change")


def build_features(df: DataFrame, models: dict[str, PipelineModel]) -> DataFrame:
    """All feature columns of the classifier."""
    rows = normalize_title(df)
    for kind in ("insert", "remove", "change"):
        rows = Fr.fragment_features(rows, fragment_scores(df, kind, models[kind]), kind)
    rows = Fr.title_features(rows, fragment_scores(df, "title", models["title"]))
    if "comment" in models:
        rows = Fr.comment_features(rows, fragment_scores(df, "comment", models["comment"]))
    return expand_actions(rows)


def scored_share(df: DataFrame) -> DataFrame:
    """Share of rows with each text score."""
    from editlens.operators.aggregates import coverage_rates

    return coverage_rates(df, ["remove_p_1_mean", "change_p_1_mean", "insert_p_1_mean"]).select(
        *[F.col(c) for c in ("has_remove_p_1_mean", "has_change_p_1_mean", "has_insert_p_1_mean", "has_any")]
    )
