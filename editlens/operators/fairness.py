"""Fairness of labels and predictions between anonymous (unprivileged) and registered (privileged) users."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editlens import schema as S
from editlens.operators import metrics as M
from editlens.operators.joins import join_many_models


def _by_side(table: DataFrame, keys: Sequence[str], flag: str, columns: Sequence[str]) -> DataFrame:
    """Metric table per flag value → one row per key: `<column>_u` (flag set) and `<column>_p`."""
    pick = lambda c, v: F.max(F.when(F.col(flag) == v, F.col(c)))
    return table.groupBy(*keys).agg(
        *[pick(c, True).alias(f"{c}_u") for c in columns], *[pick(c, False).alias(f"{c}_p") for c in columns]
    )


def _share(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def disparate_impact_base(df: DataFrame, label: str = S.LABEL, flag: str = S.ANONYMOUS) -> DataFrame:
    """P(reverted | anonymous) / P(reverted | registered)."""
    y = F.col(label).cast("int")
    return df.agg(
        F.avg(F.when(F.col(flag), y)).alias("__u"), F.avg(F.when(~F.col(flag), y)).alias("__p")
    ).select(_share(F.col("__u"), F.col("__p")).alias("disparate_impact_base"))


def disparate_impact(
    scores: DataFrame, keys: Sequence[str] = ("model",), flag: str = S.ANONYMOUS, threshold: float = S.SCORE_THRESHOLD
) -> DataFrame:
    """P(predicted | anonymous) / P(predicted | registered)."""
    hit = (F.coalesce(F.col("score"), F.lit(float(S.MISSING))) > F.lit(float(threshold))).cast("int")
    return scores.groupBy(*keys).agg(
        F.avg(F.when(F.col(flag), hit)).alias("__u"), F.avg(F.when(~F.col(flag), hit)).alias("__p")
    ).select(*keys, _share(F.col("__u"), F.col("__p")).alias("disparate_impact"))


def auc_difference(
    scores: DataFrame, keys: Sequence[str] = ("model",), flag: str = S.ANONYMOUS, label: str = S.LABEL
) -> DataFrame:
    """AUC of anonymous minus AUC of registered users."""
    table = M.roc_auc(scores, [*keys, flag], label)
    sides = _by_side(table, keys, flag, ["auc"])
    return sides.select(*keys, (F.col("auc_u") - F.col("auc_p")).alias("auc_difference"))


def _sides(scores: DataFrame, keys: Sequence[str], flag: str, label: str, threshold: float) -> DataFrame:
    table = M.metric_table(scores, [*keys, flag], label, threshold=threshold)
    table = table.withColumn("predicted_rate", _share(F.col("true_pos") + F.col("false_pos"), F.col("n")))
    return _by_side(table, keys, flag, ["revert_rate", "predicted_rate", "auc", "f1", "accuracy"])


def fairness_table(
    scores: DataFrame, keys: Sequence[str] = ("model",), flag: str = S.ANONYMOUS, label: str = S.LABEL,
    threshold: float = S.SCORE_THRESHOLD
) -> DataFrame:
    """Disparate impact of labels and of predictions, and AUC difference, per model."""
    sides = _sides(scores, keys, flag, label, threshold)
    return sides.select(
        *keys,
        _share(F.col("revert_rate_u"), F.col("revert_rate_p")).alias("disparate_impact_base"),
        _share(F.col("predicted_rate_u"), F.col("predicted_rate_p")).alias("disparate_impact"),
        (F.col("auc_u") - F.col("auc_p")).alias("auc_difference"),
    )


def group_gap_metrics(
    scores: DataFrame, keys: Sequence[str] = ("model",), flag: str = S.ANONYMOUS, label: str = S.LABEL,
    threshold: float = S.SCORE_THRESHOLD
) -> DataFrame:
    """Statistical parity, F1 and accuracy differences, and the divergence of the predicted classes
    (registered from anonymous)."""
    sides = _sides(scores, keys, flag, label, threshold)
    p, u = F.col("predicted_rate_p"), F.col("predicted_rate_u")
    part = lambda a, b: F.when(a == 0, 0.0).when(b > 0, a * F.log(a / b))
    return sides.select(
        *keys,
        (u - p).alias("statistical_parity_difference"),
        (part(p, u) + part(1 - p, 1 - u)).alias("kl_divergence"),
        (F.col("f1_u") - F.col("f1_p")).alias("f1_difference"),
        (F.col("accuracy_u") - F.col("accuracy_p")).alias("accuracy_difference"),
    )


def fairness_input(revisions: DataFrame, scores: DataFrame, models: Sequence[str], reference: str) -> DataFrame:
    """Rows that have a reference score: key, label, anonymity, one column per model, −1 for no score."""
    wide = join_many_models(scores, models)
    joined = revisions.select(*S.KEYS, S.LABEL, S.ANONYMOUS).join(wide, S.KEYS, "left")
    filled = joined.select(
        *S.KEYS, S.LABEL, S.ANONYMOUS,
        *[F.coalesce(F.col(f"{m}_pred"), F.lit(float(S.MISSING))).alias(f"{m}_pred") for m in models],
    )
    return filled.where(F.col(f"{reference}_pred") != S.MISSING)


def accuracy_by_reference(
    df: DataFrame, score: str, label: str = S.LABEL, threshold: float = S.SCORE_THRESHOLD
) -> DataFrame:
    """Share of rows the reference system decides right."""
    return M.binary_metrics(df, [], label, score, threshold).select("n", "accuracy")
