"""Classifier metrics from score counts.

Everything starts from one aggregation: rows per (group, score), split by label. Thresholds are then positions on the
running totals of those counts, so ties are handled exactly and no group has to be sorted in one task.
Undefined values (one class only, nothing predicted) are null for curve areas and 0 for precision, recall and F1.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editlens import schema as S
from editlens.functions.flags import is_true
from editlens.functions.hashing import hash_uniform
from editlens.operators.scale import null_safe_join, running

RECALL_LEVEL = 0.75
LOG_EPS = 1e-15


def _over(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def _or_zero(ratio: Column) -> Column:
    return F.coalesce(ratio, F.lit(0.0))


def score_counts(df: DataFrame, keys: Sequence[str], label: str = S.LABEL, score: str = "score") -> DataFrame:
    """Rows per (keys, score): `pos` and `neg`. Null scores count as −1, null labels are left out."""
    y = F.col(label).cast("int")
    return (
        df.where(F.col(label).isNotNull())
        .select(*keys, F.coalesce(F.col(score).cast("double"), F.lit(float(S.MISSING))).alias("score"), y.alias("__y"))
        .groupBy(*keys, "score")
        .agg(F.count_if(F.col("__y") == 1).alias("pos"), F.count_if(F.col("__y") == 0).alias("neg"))
    )


def score_path(
    df: DataFrame, keys: Sequence[str], label: str = S.LABEL, score: str = "score"
) -> DataFrame:
    """Score counts with `tp` and `fp`: positives and negatives at or above each score, `all_pos`, `all_neg`."""
    path = running(score_counts(df, keys, label, score), keys, "score", sums=["pos", "neg"], descending=True)
    return path.withColumnsRenamed({"run_pos": "tp", "run_neg": "fp"})


def _confusion(threshold: float) -> dict[str, Column]:
    above = F.col("score") > F.lit(float(threshold))
    zero = F.lit(0)
    return {
        "true_pos": F.sum(F.when(above, F.col("pos")).otherwise(zero)),
        "false_pos": F.sum(F.when(above, F.col("neg")).otherwise(zero)),
        "false_neg": F.sum(F.when(above, zero).otherwise(F.col("pos"))),
        "true_neg": F.sum(F.when(above, zero).otherwise(F.col("neg"))),
    }


def _rates() -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c) for c in ("true_pos", "false_pos", "false_neg", "true_neg"))
    return {
        "accuracy": _over(tp + tn, tp + fp + fn + tn),
        "precision": _or_zero(_over(tp, tp + fp)),
        "recall": _or_zero(_over(tp, tp + fn)),
        "f1": _or_zero(_over(2 * tp, 2 * tp + fp + fn)),
    }


def _auc_parts() -> Column:
    """Pairs won by a positive, ties counting half: negatives below the score plus half of those at it."""
    below = (F.col("all_neg") - F.col("fp")).cast("double")
    return F.sum(F.col("pos").cast("double") * (below + F.col("neg").cast("double") / 2))


def _area_parts() -> Column:
    """Trapezoids of the precision–recall curve (without the final division by the positives)."""
    tp, fp, pos, neg = (F.col(c).cast("double") for c in ("tp", "fp", "pos", "neg"))
    here = tp / (tp + fp)
    flagged_before = tp - pos + fp - neg
    before = F.when(flagged_before > 0, (tp - pos) / flagged_before).otherwise(1.0)
    return F.sum(pos * (here + before) / 2)


def _log_loss_parts() -> Column:
    p = F.least(F.greatest(F.col("score"), F.lit(LOG_EPS)), F.lit(1 - LOG_EPS))
    return F.sum(F.when(F.col("score") >= 0, -(F.col("pos") * F.log(p) + F.col("neg") * F.log(1 - p))))


def _at_recall(level: float) -> Column:
    reached = F.col("tp") > F.lit(float(level)) * F.col("all_pos")
    return F.max_by(F.when(reached, F.col("tp") / (F.col("tp") + F.col("fp"))), F.when(reached, F.col("score")))


def metric_table(
    df: DataFrame,
    keys: Sequence[str],
    label: str = S.LABEL,
    score: str = "score",
    threshold: float = S.SCORE_THRESHOLD,
    recall_level: float = RECALL_LEVEL
) -> DataFrame:
    """All metrics per group in one pass; select what is needed, the rest is pruned. Log loss skips missing scores (−1)."""
    path = score_path(df, keys, label, score)
    sums = path.groupBy(*keys).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n"),
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
        *[c.alias(n) for n, c in _confusion(threshold).items()],
        _auc_parts().alias("__auc"),
        _area_parts().alias("__area"),
        _log_loss_parts().alias("__loss"),
        F.sum(F.when(F.col("score") >= 0, F.col("pos") + F.col("neg"))).alias("__scored"),
        _at_recall(recall_level).alias("precision_at_recall"),
    )
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return sums.select(
        *keys, "n", "n_pos", "n_neg", "true_pos", "false_pos", "false_neg", "true_neg",
        *[c.alias(n) for n, c in _rates().items()],
        _over(F.col("n_pos"), F.col("n")).alias("revert_rate"),
        _over(F.col("__auc"), pairs).alias("auc"),
        _over(F.col("__area"), F.col("n_pos")).alias("pr_auc"),
        _over(F.col("__loss"), F.col("__scored")).alias("log_loss"),
        "precision_at_recall",
    )


def binary_metrics(
    df: DataFrame, keys: Sequence[str], label: str = S.LABEL, score: str = "score", threshold: float = S.SCORE_THRESHOLD
) -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1 at `score > threshold`: conditional sums only."""
    y = F.col(label).cast("int")
    above = F.coalesce(F.col(score), F.lit(float(S.MISSING))) > F.lit(float(threshold))
    sums = df.where(F.col(label).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(above & (y == 1)).alias("true_pos"),
        F.count_if(above & (y == 0)).alias("false_pos"),
        F.count_if(~above & (y == 1)).alias("false_neg"),
        F.count_if(~above & (y == 0)).alias("true_neg"),
    )
    return sums.select("*", *[c.alias(n) for n, c in _rates().items()])


def roc_auc(
    df: DataFrame, keys: Sequence[str], label: str = S.LABEL, score: str = "score"
) -> DataFrame:
    """Area under the ROC curve per group, ties by half; null if a class is missing."""
    return metric_table(df, keys, label, score).select(*keys, "n", "auc")


def log_loss(df: DataFrame, keys: Sequence[str], label: str = S.LABEL, score: str = "score") -> DataFrame:
    """Mean negative log likelihood, probabilities clipped away from 0 and 1."""
    p = F.least(F.greatest(F.col(score), F.lit(LOG_EPS)), F.lit(1 - LOG_EPS))
    loss = F.when(F.col(label).cast("int") == 1, -F.log(p)).otherwise(-F.log(1 - p))
    scored = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    return scored.groupBy(*keys).agg(F.avg(loss).alias("log_loss"))


def roc_curve(
    df: DataFrame, keys: Sequence[str], label: str = S.LABEL, score: str = "score"
) -> DataFrame:
    """False and true positive rate at every distinct score."""
    return score_path(df, keys, label, score).select(
        *keys, F.col("score").alias("threshold"),
        _over(F.col("fp"), F.col("all_neg")).alias("fpr"), _over(F.col("tp"), F.col("all_pos")).alias("tpr"),
    )


def pr_curve(
    df: DataFrame, keys: Sequence[str], label: str = S.LABEL, score: str = "score"
) -> DataFrame:
    """Precision and recall at every distinct score, and the closing point (1, 0) without a threshold."""
    points = score_path(df, keys, label, score).select(
        *keys, F.col("score").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        _over(F.col("tp"), F.col("all_pos")).alias("recall"),
    )
    return points.unionByName(_closing_point(df, keys, label))


def _closing_point(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    return df.where(F.col(label).isNotNull()).select(*keys).groupBy(*keys).agg(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )


def pr_auc(
    df: DataFrame, keys: Sequence[str], label: str = S.LABEL, score: str = "score"
) -> DataFrame:
    """Trapezoid area under the precision–recall curve."""
    return metric_table(df, keys, label, score).select(*keys, "pr_auc")


def precision_at_recall(
    df: DataFrame, keys: Sequence[str], label: str = S.LABEL, score: str = "score", level: float = RECALL_LEVEL
) -> DataFrame:
    """Precision at the highest threshold whose recall exceeds the level."""
    table = metric_table(df, keys, label, score, recall_level=level)
    return table.select(*keys, "precision_at_recall")


def pr_envelope(
    df: DataFrame, keys: Sequence[str], label: str = S.LABEL, score: str = "score"
) -> DataFrame:
    """Precision–recall curve whose precision never falls as the threshold rises."""
    points = score_path(df, keys, label, score).select(
        *keys, F.col("score").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        _over(F.col("tp"), F.col("all_pos")).alias("recall"),
    )
    smooth = running(points, keys, "threshold", maxes=["precision"])
    return smooth.select(*keys, "threshold", F.col("run_precision").alias("precision"), "recall").unionByName(
        _closing_point(df, keys, label)
    )


SWEEP = [t / 100 for t in range(50, 100, 5)]


def threshold_sweep(
    df: DataFrame, keys: Sequence[str], label: str = S.LABEL, score: str = "score", thresholds: Sequence[float] = SWEEP
) -> DataFrame:
    """Per threshold: rows, reverts, flagged rows, flagged reverts, precision and recall of `score > threshold`.

    One aggregation with two conditional counts per threshold, then one row per threshold.
    """
    y = F.col(label).cast("int")
    s = F.coalesce(F.col(score), F.lit(float(S.MISSING)))
    counts = []
    for i, t in enumerate(thresholds):
        counts += [F.count_if(s > F.lit(t)).alias(f"__f{i}"), F.count_if((s > F.lit(t)) & (y == 1)).alias(f"__h{i}")]
    sums = df.where(F.col(label).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(y == 1).alias("reverts"), *counts
    )
    rows = sums.select(*keys, "total", "reverts", F.inline(F.array(*[
        F.struct(F.lit(t).alias("threshold"), F.col(f"__f{i}").alias("flagged"), F.col(f"__h{i}").alias("hits"))
        for i, t in enumerate(thresholds)
    ])))
    return rows.select(
        "*", _over(F.col("hits"), F.col("flagged")).alias("precision"),
        F.when(F.col("flagged") > 0, _over(F.col("hits"), F.col("reverts"))).alias("recall"),
    )


def confusion_matrix(
    df: DataFrame, keys: Sequence[str], label: str = S.LABEL, score: str = "score", threshold: float = S.SCORE_THRESHOLD
) -> DataFrame:
    """One row per group, true and predicted class, zero cells included."""
    sums = binary_metrics(df, keys, label, score, threshold)
    cells = [(0, 0, "true_neg"), (0, 1, "false_pos"), (1, 0, "false_neg"), (1, 1, "true_pos")]
    return sums.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(c).alias("row_count")) for a, p, c in cells
    ])))


def text_model_auc(
    df: DataFrame, columns: dict[str, str], label: str = S.LABEL, anonymous: str = S.ANONYMOUS
) -> DataFrame:
    """AUC of each text score over the rows that have it, for all users and for anonymous ones."""
    populations = F.array(F.lit("all"), F.when(is_true(F.col(anonymous)), F.lit("anonymous")))
    entries = F.array(*[
        F.struct(F.lit(n).alias("model"), F.col(c).cast("double").alias("score")) for n, c in columns.items()
    ])
    rows = df.select(label, populations.alias("__p"), F.inline(entries)).where(
        F.col("score").isNotNull() & (F.col("score") != S.MISSING)
    )
    rows = rows.select(label, "model", "score", F.explode("__p").alias("population")).where("population is not null")
    return roc_auc(rows, ["model", "population"], label)


def baseline_anonymous(df: DataFrame, keys: Sequence[str] = (), label: str = S.LABEL) -> DataFrame:
    """Metrics of the score "is anonymous"."""
    scored = df.withColumn("score", is_true(F.col(S.ANONYMOUS)).cast("double"))
    return metric_table(scored, keys, label)


def baseline_random(df: DataFrame, keys: Sequence[str] = (), label: str = S.LABEL, seed: int = S.SEED) -> DataFrame:
    """AUC of a random but repeatable score."""
    return roc_auc(df.withColumn("score", hash_uniform(*S.KEYS, seed=seed)), keys, label)


def agreement_rates(
    df: DataFrame, columns: Sequence[str], label: str = S.LABEL, threshold: float = S.SCORE_THRESHOLD
) -> DataFrame:
    """Shares of rows where the models are all right or all wrong, all right, at least one right."""
    y = F.col(label).cast("int")
    right = F.lit(0)
    for c in columns:
        right = right + ((F.col(c) > F.lit(float(threshold))).cast("int") == y).cast("int")
    k = len(columns)
    scored = df.where(F.col(label).isNotNull()).select(right.alias("__r"))
    share = lambda c: F.avg(c.cast("double"))
    return scored.agg(
        share((F.col("__r") == 0) | (F.col("__r") == k)).alias("all_same"),
        share(F.col("__r") == k).alias("all_correct"),
        share(F.col("__r") > 0).alias("any_correct"),
    )


def rmse(df: DataFrame, target: str, prediction: str) -> DataFrame:
    """Root mean squared error."""
    return df.agg(F.sqrt(F.avg(F.pow(F.col(target) - F.col(prediction), 2))).alias("rmse"))


def accuracy_f1_text(df: DataFrame, label: str = "label", s0: str = "s_0", s1: str = "s_1") -> DataFrame:
    """Accuracy and F1 of the class with the larger raw score (class 0 on a tie)."""
    larger = (F.col(s1) > F.col(s0)).cast("double")
    return binary_metrics(df.withColumn("score", larger), [], label).select("accuracy", "f1")


def join_metrics(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two metric tables side by side."""
    return null_safe_join(left, right, list(keys), "left")
