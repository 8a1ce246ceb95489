"""Evaluation job: scores of several models → leaderboard, slices and fairness."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editlens import schema as S
from editlens.functions.flags import is_true
from editlens.operators import fairness, joins, sampling, slices
from editlens.operators.revisions import filter_scored
from editlens.session import materialize


def long_scores(test: DataFrame, models: dict[str, str], ids: list[str] | None = None) -> DataFrame:
    """Test rows × models in long form, one column per model going in."""
    ids = ids or [*S.KEYS, S.LABEL, S.ANONYMOUS, S.TIMESTAMP]
    return joins.unpivot_scores(test, ids, models)


def evaluate(test: DataFrame, models: dict[str, str], reference: str, min_rows: int = 0) -> dict[str, DataFrame]:
    """All result tables. Rows are balanced first and then narrowed to those the reference system has scored."""
    test = materialize(test.withColumn("__anonymous", is_true(F.col(S.ANONYMOUS)).cast("double")), "test")
    models = models | {"__anonymous": "baseline"}
    scores = lambda rows: long_scores(filter_scored(rows, [reference]), models)
    unbalanced = scores(test)
    return {
        "leaderboard": slices.model_leaderboard(
            unbalanced, scores(sampling.balance_per_language(test)), scores(sampling.balance_two_sided(test))
        ),
        "by_wiki": slices.metrics_by_wiki(unbalanced, min_rows=min_rows),
        "by_day": slices.metrics_by_day(unbalanced),
        "fairness": fairness.fairness_table(unbalanced),
    }
