"""Metrics per wiki, day, group, quantile and population."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editlens import schema as S
from editlens.functions.flags import is_true
from editlens.operators import metrics as M
from editlens.operators.joins import join_dimension
from editlens.operators.scale import exact_quantiles

QUANTILES = 12


def metrics_by_group(
    scores: DataFrame, keys: Sequence[str], counted: str | None = None
) -> DataFrame:
    """F1, accuracy and AUC per model and group. `counted`: also the number of rows where that column is set."""
    by = ["model", *keys]
    table = M.metric_table(scores, by).select(*by, "n", "f1", "accuracy", "auc")
    if counted is None:
        return table
    samples = scores.groupBy(*by).agg(F.count(counted).alias("samples_count"))
    return M.join_metrics(table, samples, by)


def metrics_by_day(
    scores: DataFrame, keys: Sequence[str] = (), timestamp: str = S.TIMESTAMP
) -> DataFrame:
    """Accuracy and AUC per model and day of month, optionally per wiki."""
    daily = scores.withColumn("day", F.dayofmonth(timestamp))
    return metrics_by_group(daily, [*keys, "day"]).drop("f1")


def metrics_by_wiki(
    scores: DataFrame, articles: DataFrame | None = None, min_rows: int = 0
) -> DataFrame:
    """AUC per model and wiki with size, revert rate, anonymous rate and number of articles."""
    by = ["model", S.WIKI]
    auc = M.metric_table(scores, by).select(*by, "n", "revert_rate", "auc")
    anonymous = scores.where(F.col(S.LABEL).isNotNull()).groupBy(*by).agg(
        F.avg(F.col(S.ANONYMOUS).cast("int")).alias("anonymous_rate")
    )
    table = M.join_metrics(auc, anonymous, by).where(F.col("n") > min_rows)
    return table if articles is None else join_dimension(table, articles, [S.WIKI])


def metrics_grouping_sets(scores: DataFrame) -> DataFrame:
    """All metrics for every wiki and for all together (`all`), per model."""
    both = scores.select(
        "*", F.explode(F.array(F.lit("all"), F.col(S.WIKI))).alias("scope")
    )
    return M.metric_table(both, ["model", "scope"])


def rate_grouping_sets(df: DataFrame, key: str = S.WIKI, label: str = S.LABEL) -> DataFrame:
    """Rows and revert rate per wiki and in total, in one aggregation."""
    return (
        df.groupingSets([[], [F.col(key)]], F.col(key))
        .agg(
            F.grouping(key).alias("__total"), F.count(F.lit(1)).alias("row_count"),
            F.avg(F.col(label).cast("int")).alias("revert_rate"),
        )
        .select(F.when(F.col("__total") == 1, F.lit("all")).otherwise(F.col(key)).alias("scope"), "row_count", "revert_rate")
    )


def quantile_buckets(
    df: DataFrame, column: str, name: str, q: int = QUANTILES
) -> DataFrame:
    """Bucket of a value among q equal-count ones, labelled q (lowest) to 1; equal values share a bucket, null has none.

    The q − 1 inner edges are one row; they become constants of a row-wise expression.
    """
    edges = exact_quantiles(df, [], column, [i / q for i in range(1, q)]).first()
    value = F.col(column).cast("double")
    above = F.lit(0)
    for i in range(q - 1):
        edge = edges[f"q_{i}"] if edges else None
        above = above + F.when(value > F.lit(edge).cast("double"), 1).otherwise(0)
    return df.withColumn(name, F.when(F.col(column).isNotNull(), F.lit(q) - above))


def metrics_by_quantile(
    scores: DataFrame, rows: DataFrame, column: str, q: int = QUANTILES
) -> DataFrame:
    """Metrics per model and quantile bucket. Edges come from `rows`, which has one row per revision."""
    edges = exact_quantiles(rows, [], column, [i / q for i in range(1, q)]).first()
    value = F.col(column).cast("double")
    above = F.lit(0)
    for i in range(q - 1):
        above = above + F.when(value > F.lit(edges[f"q_{i}"] if edges else None).cast("double"), 1).otherwise(0)
    bucketed = scores.withColumn("bucket", F.when(F.col(column).isNotNull(), F.lit(q) - above))
    return metrics_by_group(bucketed.where(F.col("bucket").isNotNull()), ["bucket"])


def model_leaderboard(
    unbalanced: DataFrame, balanced: DataFrame, balanced_anonymous: DataFrame
) -> DataFrame:
    """Per model and population: accuracy and F1 on the balanced rows, AUC and precision at recall on all rows.

    Inputs are long scores (model, label, is_anonymous, score).
    """
    by = ["model", "population"]
    anonymous = is_true(F.col(S.ANONYMOUS))
    full = unbalanced.select(
        "model", S.LABEL, "score",
        F.explode(F.array_compact(F.array(F.lit("all"), F.when(anonymous, F.lit("anonymous"))))).alias("population"),
    )
    even = balanced.select("model", S.LABEL, "score", F.lit("all").alias("population")).unionByName(
        balanced_anonymous.select("model", S.LABEL, "score", F.lit("anonymous").alias("population"))
    )
    ranked = M.metric_table(full, by).select(*by, "auc", "precision_at_recall")
    decided = M.binary_metrics(even, by).select(*by, "accuracy", "f1")
    return M.join_metrics(ranked, decided, by)


def eval_metric_set(
    df: DataFrame, label: str = S.LABEL, score: str = "score", balanced: str = "is_balanced", within: Sequence[str] = ()
) -> DataFrame:
    """Log loss, AUC, precision, recall, F1 and accuracy: all rows and balanced rows, in total and per wiki.

    With `within` (columns), all of them for each value of those.
    """
    keys = [*within, "part", "scope"]
    parts = F.array_compact(F.array(F.lit("full"), F.when(F.col(balanced) == 1, F.lit("balanced"))))
    rows = df.select(*within, label, score, S.WIKI, F.explode(parts).alias("part"))
    rows = rows.select(*within, label, score, "part", F.explode(F.array(F.lit("all"), F.col(S.WIKI))).alias("scope"))
    return M.metric_table(rows, keys, label, score).select(
        *keys, "n", "revert_rate", "log_loss", "auc", "precision", "recall", "f1", "accuracy"
    )
