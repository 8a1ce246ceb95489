"""Exact, repeatable samples and splits.

All of them order keys by a seeded hash and keep the first n of each group. Hashes are even, so the n-th of them is within a
few times √n places of n / size: after the groups are counted (which reads no keys), one pass over the keys counts what lies
below that stretch and takes the hashes within it, and the n-th is found among those. The sample itself is then a plain filter
`hash <= limit`, with no shuffle of the rows. Keys must be unique per group.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from editlens import schema as S
from editlens.functions.flags import is_true
from editlens.functions.hashing import hash_order, hash_uniform
from editlens.operators.scale import null_safe_join

PREFIX = 3  # hex digits: 4,096 prefixes per group
WIDTH = 10.0  # standard deviations on either side of the expected place of the last key
EVERYTHING = "g"  # sorts after every hex digest
GROUP_SIZE = "__size"
_DIGITS = 13  # hex digits of a bound: 52 bits, as many as a double holds


def hash_limits(
    df: DataFrame, groups: Sequence[str], keys: Sequence[str], quota: Column, seed: int = S.SEED, prefix: int = PREFIX,
    width: float = WIDTH, few: bool = False,
) -> DataFrame:
    """Per group the hash of its last sampled key, `__limit`.

    `few` says that there are few groups, such as classes: what is known of them goes to every task then, and the rows stay
    in place. Else Spark decides, from sizes of files that tell little about rows: it may send the rows to every task, or deal
    them by group, which puts a class into one task.

    `quota` is the number of keys to take, an expression of the group columns, GROUP_SIZE, and window sums of `__n`
    (keys per group) over a part of the group columns.

    One key in 10²³ samples would lie outside the stretch that is looked at. Keys outside it are counted per hash prefix
    as well; if the quota ends there (keys repeat very often, against the rule), the sample goes on to the end of that prefix.
    """
    groups = list(groups)
    sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n")).withColumn(GROUP_SIZE, F.col("__n"))
    sizes = sizes.withColumn("__quota", F.coalesce(quota.cast("long"), F.lit(0))).drop("__n")
    partial = (F.col("__quota") > 0) & (F.col("__quota") < F.col(GROUP_SIZE))
    whole = F.when(F.col("__quota") >= F.col(GROUP_SIZE), F.lit(EVERYTHING)).otherwise(F.lit(""))

    hashed = df.select(*groups, hash_order(*keys, seed=seed).alias("__hash"))
    near = _by_group(hashed, _stretch(sizes.where(partial), width), groups, few).where(F.col("__low").isNotNull())
    start = F.substring("__hash", 1, prefix)
    cell = F.when(F.col("__hash") < F.col("__low"), start).when(F.col("__hash") <= F.col("__high"), F.col("__hash")).otherwise(
        F.concat(start, F.lit(EVERYTHING))
    )
    counts = near.groupBy(*groups, "__low", "__quota", cell.alias("__cell")).agg(F.count(F.lit(1)).alias("__n"))
    in_order = (Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))).orderBy("__cell")
    upto = F.sum("__n").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = counts.withColumn("__upto", upto).where("__upto >= __quota AND __upto - __n < __quota")
    limit = F.when(
        F.col("__cell") < F.col("__low"), F.least(F.concat("__cell", F.lit(EVERYTHING)), F.col("__low"))
    ).otherwise(F.col("__cell"))
    return last.select(*groups, limit.alias("__limit")).unionByName(sizes.where(~partial).select(*groups, whole.alias("__limit")))


def _stretch(sizes: DataFrame, width: float) -> DataFrame:
    """Adds the bounds `__low` and `__high` between which the last key of a group lies, as starts of hashes."""
    size, quota = F.greatest(F.col(GROUP_SIZE), F.lit(1)).cast("double"), F.col("__quota").cast("double")
    share = quota / size
    reach = (F.lit(width) * F.sqrt(quota * F.greatest(1 - share, F.lit(0.0))) + F.lit(width)) / size
    digits = lambda x: F.lpad(F.lower(F.hex((x * F.lit(float(16**_DIGITS))).cast("long"))), _DIGITS, "0")
    return sizes.withColumns({
        "__low": digits(F.greatest(share - reach, F.lit(0.0))),
        "__high": F.when(share + reach >= 1, F.lit(EVERYTHING)).otherwise(digits(share + reach)),
    }).drop(GROUP_SIZE)


def _by_group(left: DataFrame, right: DataFrame, groups: Sequence[str], few: bool = False) -> DataFrame:
    """Adds the columns of a frame with one row per group; without groups, of its only row (null if there is none)."""
    if groups:
        return null_safe_join(left, F.broadcast(right) if few else right, groups, "inner")
    names = [c for c in right.columns if c not in left.columns]
    row = right.select(F.struct(*names).alias("row")).scalar()
    return left.withColumn("__only", row).withColumns({c: F.col("__only")[c] for c in names}).drop("__only")


def sampled(
    df: DataFrame,
    groups: Sequence[str],
    keys: Sequence[str],
    quota: Column,
    seed: int = S.SEED,
    source: DataFrame | None = None,
    prefix: int = PREFIX,
    width: float = WIDTH,
    few: bool = False,
) -> tuple[DataFrame, Column]:
    """The frame with its group limits attached, and the condition "this row is in the sample"."""
    limits = hash_limits(df if source is None else source, groups, keys, quota, seed, prefix, width, few)
    joined = _by_group(df, limits, list(groups), few)
    return joined, hash_order(*keys, seed=seed) <= F.col("__limit")


def _keep(df: DataFrame, groups: Sequence[str], keys: Sequence[str], quota: Column, seed: int, prefix: int) -> DataFrame:
    joined, chosen = sampled(df, groups, keys, quota, seed, prefix=prefix)
    return joined.where(chosen).drop("__limit")


def _class_size(scope: Sequence[str], label: str, value: int) -> Column:
    """Rows of a class within the scope of a group."""
    whole = Window.partitionBy(*scope) if scope else Window.partitionBy(F.lit(0))
    size = F.sum(F.when(F.col(label).cast("int") == value, F.col("__n"))).over(whole)
    return F.coalesce(size, F.lit(0))


def _negatives_capped(scope: Sequence[str], label: str) -> Column:
    """All positives, as many negatives at most; other labels none."""
    n1 = _class_size(scope, label, 1)
    y = F.col(label).cast("int")
    return F.when(y == 1, n1).when(y == 0, n1).otherwise(0)


def _both_capped(scope: Sequence[str], label: str) -> Column:
    """The smaller class whole, the larger one cut to its size."""
    smaller = F.least(_class_size(scope, label, 0), _class_size(scope, label, 1))
    return F.when(F.col(label).isNotNull(), smaller).otherwise(0)


def sample_cap(
    df: DataFrame,
    max_rows: int,
    groups: Sequence[str] = (S.WIKI,),
    keys: Sequence[str] = (S.ID,),
    seed: int = S.SEED,
    exact: bool = True,
    prefix: int = PREFIX,
) -> DataFrame:
    """At most `max_rows` per group (per wiki). With `exact=False` a row stays with probability max_rows / size."""
    if exact:
        return _keep(df, groups, keys, F.lit(max_rows), seed, prefix)
    sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias(GROUP_SIZE))
    return null_safe_join(df, sizes, list(groups)).where(
        hash_uniform(*keys, seed=seed) < F.lit(float(max_rows)) / F.col(GROUP_SIZE)
    ).drop(GROUP_SIZE)


def sample_cap_by_class(
    df: DataFrame, max_rows: int, label: str = S.LABEL, groups: Sequence[str] = (), keys: Sequence[str] = S.KEYS,
    seed: int = S.SEED, prefix: int = PREFIX,
) -> DataFrame:
    """Negatives capped at `max_rows`; positives at the number of capped negatives or their own, whichever is less."""
    kept = F.least(_class_size(groups, label, 0), F.lit(max_rows))
    quota = F.when(F.col(label).isNotNull(), kept).otherwise(0)
    return _keep(df, [*groups, label], keys, quota, seed, prefix)


def balance_flag(
    df: DataFrame, scope: Sequence[str] = (S.WIKI,), label: str = S.LABEL, keys: Sequence[str] = (S.ID,),
    seed: int = S.SEED, prefix: int = PREFIX,
) -> DataFrame:
    """`is_balanced`: 1 for all positives and as many negatives per scope (wiki and split part); null label → 0."""
    joined, chosen = sampled(df, [*scope, label], keys, _negatives_capped(scope, label), seed, prefix=prefix)
    return joined.withColumn("is_balanced", F.coalesce(chosen, F.lit(False)).cast("int")).drop("__limit")


def balance_per_language(df: DataFrame, label: str = S.LABEL, seed: int = S.SEED, prefix: int = PREFIX) -> DataFrame:
    """Per wiki all positives and as many negatives (fewer if there are not enough)."""
    return _keep(df, [S.WIKI, label], [S.ID], _negatives_capped([S.WIKI], label), seed, prefix)


def balance_two_sided(df: DataFrame, label: str = S.LABEL, seed: int = S.SEED, prefix: int = PREFIX) -> DataFrame:
    """Anonymous edits only; per wiki the larger class is cut to the size of the smaller."""
    anonymous = df.where(is_true(F.col(S.ANONYMOUS)))
    return _keep(anonymous, [S.WIKI, label], [S.ID], _both_capped([S.WIKI], label), seed, prefix)


def balance_training_set(
    df: DataFrame, label: str = "label", keys: Sequence[str] = ("lang", S.ID), seed: int = S.SEED, prefix: int = PREFIX
) -> DataFrame:
    """All positives and as many negatives, over all wikis together."""
    return _keep(df, [label], keys, _negatives_capped([], label), seed, prefix)


def split_by_time(df: DataFrame, cut: str, column: str = S.TIMESTAMP) -> DataFrame:
    """`part`: train before the cut, test from it on."""
    kind = df.schema[column].dataType
    return df.withColumn("part", F.when(F.col(column) < F.lit(cut).cast(kind), "train").otherwise("test"))


def split_by_title(
    df: DataFrame, share: float = 0.6, title: str = S.TITLE, seed: int = S.SEED, prefix: int = PREFIX
) -> DataFrame:
    """`is_text_train`: per wiki 1 for ⌊share · n⌋ of the n distinct titles, so all rows of a title are on one side."""
    titles = df.select(S.WIKI, title).distinct()
    quota = F.floor(F.col(GROUP_SIZE) * F.lit(share))
    joined, chosen = sampled(df, [S.WIKI], [title], quota, seed, source=titles, prefix=prefix)
    return joined.withColumn("is_text_train", F.coalesce(chosen, F.lit(False)).cast("int")).drop("__limit")


def split_stratified(
    df: DataFrame, test_share: float = 0.1, label: str = S.LABEL, keys: Sequence[str] = S.KEYS, seed: int = S.SEED,
    prefix: int = PREFIX,
) -> DataFrame:
    """`part`: test for ⌈share · n⌉ rows of each label, train for the rest. Labels are classes, so there are few."""
    quota = F.ceil(F.col(GROUP_SIZE) * F.lit(test_share))
    joined, chosen = sampled(df, [label], keys, quota, seed, prefix=prefix, few=True)
    return joined.withColumn("part", F.when(chosen, "test").otherwise("train")).drop("__limit")


def split_random(
    df: DataFrame, test_share: float = 0.05, keys: Sequence[str] = S.KEYS, seed: int = S.SEED, prefix: int = PREFIX
) -> DataFrame:
    """`part`: test for ⌈share · n⌉ rows, train for the rest."""
    quota = F.ceil(F.col(GROUP_SIZE) * F.lit(test_share))
    joined, chosen = sampled(df, [], keys, quota, seed, prefix=prefix)
    return joined.withColumn("part", F.when(chosen, "test").otherwise("train")).drop("__limit")


def split_by_day(
    df: DataFrame, train_days: tuple[int, int] = (1, 5), test_days: tuple[int, int] = (6, 7), column: str = S.TIMESTAMP
) -> DataFrame:
    """`part` by day of month; other days are dropped."""
    day = F.dayofmonth(column)
    part = F.when(day.between(*train_days), "train").when(day.between(*test_days), "test")
    return df.withColumn("part", part).where(F.col("part").isNotNull())
