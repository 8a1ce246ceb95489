"""Training job: collected revisions → text models, classifier and written scores of the revisions after a day."""

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from editlens import schema as S
from editlens.models import classifier as C
from editlens.operators.joins import lookup_scores, lookup_user_features
from editlens.operators.revisions import filter_split, rename_features
from editlens.plans import features, preparation
from editlens.session import materialize
from editlens.sources import files


@dataclass(frozen=True)
class JobSettings:
    """`cut` is the first day of the test part; sizes of the text models and of the classifier."""

    cut: str
    text_width: int = 1 << 18
    text_rounds: int = 20
    classifier: C.TrainingSettings = field(default_factory=C.TrainingSettings)
    user_features: bool = True


def classifier_rows(rows: DataFrame, text_models: dict[str, PipelineModel], users: DataFrame) -> DataFrame:
    """Revisions with every input of the classifier, under the names it knows. A revision without user features has nulls."""
    return rename_features(lookup_user_features(features.build_features(rows, text_models), users))


def train_and_score(
    collected: DataFrame, users: DataFrame, scores_path: str, settings: JobSettings
) -> tuple[PipelineModel, DataFrame]:
    """Trains on the revisions before the cut and writes the scores of those from it on.

    Text models learn from the text side of the title split, the classifier from the other side, so that it sees text scores
    as they are on unread texts. `users` has the flags of user groups per (wiki, revision). Returns the classifier and the
    test rows with user features and `predict_score` as it was written.
    """
    train, test = (materialize(part, "part") for part in preparation.train_and_test(collected, settings.cut))
    text_models = features.train_text_models(train, settings.text_width, settings.text_rounds)
    names = S.feature_list(user_features=settings.user_features)
    model = C.train_classifier(
        classifier_rows(filter_split(train, text_train=False), text_models, users), names, settings=settings.classifier
    )
    scored = C.predict_scores(model, classifier_rows(test, text_models, users), names)
    files.write_scores(scored, scores_path)
    written = files.read_parquet(collected.sparkSession, scores_path)
    return model, lookup_scores(lookup_user_features(test, users), written, "predict_score")
