"""Building blocks that keep joins, running totals and exact samples spread over the cluster. Every one of them is exact."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PER_OCTAVE = 512
#: Ranges of values in a running total: as many as there are shuffle partitions, within these bounds.
LEAST_RANGES, MOST_RANGES = 64, 4096


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join in which a null key meets a null key. The left side's keys are kept."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def value_bucket(value: Column) -> Column:
    """A number that rises with the value and has at most 512 steps per power of two; null lowest, NaN highest.

    It depends on the value alone, so buckets need no look at the data.
    """
    v = value.cast("double")
    step = F.floor(F.least(F.log2(F.abs(v)) * PER_OCTAVE, F.lit(600_000.0))) + 1_000_000
    return (
        F.when(value.isNull(), F.lit(-10_000_000)).when(F.isnan(v), F.lit(10_000_000)).when(v == 0, F.lit(0))
        .when(v < 0, -step).otherwise(step).cast("int")
    )


def _with_range(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds the number of the range of a value; ranges hold about equally many rows of `df`, whatever the values look like.

    The bounds come from a quantile sketch that tasks merge, as a subquery of the same job. A value is looked for among
    every so many bounds first, then between two of them. Null is lowest, NaN highest.
    """
    n = min(max(LEAST_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), MOST_RANGES)
    step = max(1, round(n**0.5))
    sketch = df.agg(F.percentile_approx(value, [i / n for i in range(1, n)], 4 * n).alias("b"))
    bounds = sketch.select(F.struct("b", F.filter("b", lambda _, i: i % step == 0).alias("first")).alias("__bounds")).scalar()
    below = lambda array: F.size(F.filter(array, lambda bound: bound < value))
    whole = F.greatest(below(F.col("__bounds.first")) - 1, F.lit(0)) * step
    place = whole + below(F.slice(F.col("__bounds.b"), whole + 1, F.lit(step)))
    number = F.when(value.isNull(), F.lit(-1)).otherwise(F.coalesce(place, F.lit(0)))
    return df.withColumn("__bounds", bounds).withColumn(name, number).drop("__bounds")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Sequence[str] = (),
    maxes: Sequence[str] = (),
    descending: bool = False,
) -> DataFrame:
    """Running totals and maxima along `order` within each key, plus totals per key.

    `df` has one row per (keys, order). Adds `run_<c>` (this row included), and `all_<c>` for sums. Values fall into
    ranges of like row counts: running totals over the ranges' totals, then within each range, so that no task sees a whole
    group, and a narrow span of values (a year of timestamps, say) is cut as finely as a wide one.
    """
    keys = list(keys)
    by = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    cut = _with_range(df, F.col(order).cast("double"), "__bucket")
    bucket_keys = [*keys, "__bucket"]
    totals = cut.groupBy(*bucket_keys).agg(
        *[F.sum(c).alias(f"__t_{c}") for c in sums], *[F.max(c).alias(f"__t_{c}") for c in maxes]
    )
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = whole.orderBy(by("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *bucket_keys,
        *[F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__off_{c}") for c in sums],
        *[F.max(f"__t_{c}").over(before).alias(f"__off_{c}") for c in maxes],
        *[F.sum(f"__t_{c}").over(whole).alias(f"all_{c}") for c in sums],
    )
    local = (
        Window.partitionBy(*bucket_keys).orderBy(by(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = null_safe_join(cut, offsets, bucket_keys)
    return joined.select(
        *df.columns,
        *[(F.sum(c).over(local) + F.col(f"__off_{c}")).alias(f"run_{c}") for c in sums],
        *[F.greatest(F.max(c).over(local), F.col(f"__off_{c}")).alias(f"run_{c}") for c in maxes],
        *[f"all_{c}" for c in sums],
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    probabilities: Sequence[float],
) -> DataFrame:
    """Quantiles with linear interpolation, `q_0 … q_k` per key, from value counts and running totals."""
    rows = df.select(*keys, F.col(column).cast("double").alias("__v"))
    counts = rows.where(F.col("__v").isNotNull()).groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n"))
    ranked = running(counts, keys, "__v", sums=["__n"])
    found, at = [], []
    for i, p in enumerate(probabilities):
        rank = (F.col("all___n") - 1) * F.lit(float(p))
        found += [
            F.min(F.when(F.col("run___n") > F.floor(rank), F.col("__v"))).alias(f"__lo_{i}"),
            F.min(F.when(F.col("run___n") > F.ceil(rank), F.col("__v"))).alias(f"__hi_{i}"),
        ]
        share = (F.col("__all") - 1) * F.lit(float(p))
        at.append(
            (F.col(f"__lo_{i}") + (share - F.floor(share)) * (F.col(f"__hi_{i}") - F.col(f"__lo_{i}"))).alias(f"q_{i}")
        )
    return ranked.groupBy(*keys).agg(F.max("all___n").alias("__all"), *found).select(*keys, *at)


def average_ranks(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column with their rank; tied rows share the mean of their ranks."""
    rows = df.select(column)
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    ranked = running(counts, [], column, sums=["n"])
    return ranked.select(column, (F.col("run_n") - F.col("n") + (F.col("n") + 1) / 2.0).alias("rank"))
