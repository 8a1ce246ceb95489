"""Filters, joins and flags on the revision history."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editlens import schema as S
from editlens.functions import flags
from editlens.functions.text import readable_title


def filter_time_range(df: DataFrame, start: str, end: str, column: str = S.TIMESTAMP) -> DataFrame:
    """Rows in [start, end)."""
    kind = df.schema[column].dataType
    return df.where((F.col(column) >= F.lit(start).cast(kind)) & (F.col(column) < F.lit(end).cast(kind)))


def cast_label(df: DataFrame, label: str = S.LABEL) -> DataFrame:
    """Boolean label → 0/1."""
    return df.withColumn(label, F.col(label).cast("int"))


def join_reverting_revision(
    df: DataFrame, candidates: DataFrame | None = None, keys: Sequence[str] = (S.WIKI,)
) -> DataFrame:
    """Adds, from the first reverting revision, whether it was reverted itself and its user's groups.

    `candidates` are the rows a reverter is looked up in: the whole history (default: `df` itself), or only a
    window of it. Most revisions have no reverter; they get a key of their own that nothing matches, so that
    nulls do not pile up in one partition.
    """
    source = candidates if candidates is not None else df
    right = source.select(
        *[F.col(k).alias(f"__{k}") for k in keys],
        F.col(S.ID).alias("__reverter"),
        F.col(S.LABEL).cast("boolean").alias(S.REVERTER_REVERTED),
        F.col("event_user_groups").alias(S.REVERTER_GROUPS),
    )
    left = df.withColumn("__lookup", F.coalesce(F.col(S.REVERTER), -1 - F.col(S.ID)))
    on = [F.col("__lookup") == F.col("__reverter"), *[F.col(k) == F.col(f"__{k}") for k in keys]]
    return left.join(right, on, "left").drop("__lookup", "__reverter", *[f"__{k}" for k in keys])


def fill_null_flag(df: DataFrame, column: str = S.REVERTER_REVERTED) -> DataFrame:
    """Null flag → false."""
    return df.withColumn(column, flags.is_true(F.col(column)))


def filter_revert_wars(df: DataFrame, column: str = S.REVERTER_REVERTED) -> DataFrame:
    """Drops revisions whose reverting revision was itself reverted. Null counts as not reverted."""
    return df.where(~flags.is_true(F.col(column).cast("boolean")))


def filter_bots(df: DataFrame, column: str = "event_user_is_bot_by") -> DataFrame:
    """Drops edits by bots: those with any bot mark."""
    return df.where(~flags.is_filled(F.col(column)))


def filter_new_pages(df: DataFrame, column: str = S.PARENT) -> DataFrame:
    """Drops page creations, which have no parent revision."""
    return df.where(F.col(column) != 0)


def filter_anonymous(df: DataFrame, column: str = "event_user_is_anonymous") -> DataFrame:
    """Keeps edits by anonymous users."""
    return df.where(flags.is_true(F.col(column)))


def filter_both_texts(df: DataFrame, current: str = "revision_text", parent: str = "parent_text") -> DataFrame:
    """Keeps rows that have both texts."""
    return df.where(F.col(current).isNotNull() & F.col(parent).isNotNull())


def filter_split(df: DataFrame, text_train: bool, column: str = "is_text_train") -> DataFrame:
    """One side of the title split: for the text models, or for the classifier."""
    return df.where(F.col(column) == int(text_train))


def filter_placeholder_text(df: DataFrame, columns: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Drops rows where a sentence is missing or only a placeholder such as `N/A`."""
    for c in columns:
        df = df.where(F.col(c).isNotNull() & ~F.col(c).isin([*S.PLACEHOLDER_TEXTS, *extra]))
    return df


def filter_scored(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keeps rows where every compared model has a score (neither null nor −1)."""
    for c in columns:
        df = df.where(F.col(c).isNotNull() & (F.col(c) != S.MISSING))
    return df


def slices(wiki: str | None = None) -> dict[str, Column]:
    """Named predicates of the evaluation."""
    return {
        "all": F.lit(True),
        "balanced": flags.is_true(F.col("is_balanced") == 1),
        "anonymous": flags.is_true(F.col(S.ANONYMOUS)),
        "registered": ~flags.is_true(F.col(S.ANONYMOUS)),
        "geolocated": F.col("country_iso_code").isNotNull(),
        "text_changed": flags.is_true(F.col("text_changes_found")),
        "has_insert": F.coalesce(F.col("insert_p_1_mean"), F.lit(S.MISSING)) != S.MISSING,
        "has_change": F.coalesce(F.col("change_p_1_mean"), F.lit(S.MISSING)) != S.MISSING,
        "has_remove": F.coalesce(F.col("remove_p_1_mean"), F.lit(S.MISSING)) != S.MISSING,
        "wiki": F.col(S.WIKI) == F.lit(wiki),
    }


def filter_slice(df: DataFrame, name: str, wiki: str | None = None) -> DataFrame:
    """Rows of one named evaluation slice."""
    return df.where(slices(wiki)[name])


def normalize_title(df: DataFrame, column: str = S.TITLE) -> DataFrame:
    """Title with spaces, null as empty."""
    return df.withColumn(column, readable_title(F.col(column)))


def rename_features(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Bulk rename of feature columns to the names the classifier knows."""
    names = S.FEATURE_RENAMES | S.LEGACY_ACTION_RENAMES if names is None else names
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def fill_missing_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null features → −1; flags become 0 / 1, text `-1`."""
    kinds = dict(df.dtypes)
    filled = {}
    for c in columns:
        ref = F.col(f"`{c}`")
        if kinds[c] == "string":
            filled[c] = F.coalesce(ref, F.lit(str(S.MISSING)))
        else:
            filled[c] = F.coalesce(ref.cast("int") if kinds[c] == "boolean" else ref, F.lit(S.MISSING))
    return df.withColumns(filled)


def flag_trusted_reverter(df: DataFrame, column: str = S.REVERTER_GROUPS) -> DataFrame:
    """`is_reverted_by_good_user`: 1 if the reverter is in a trusted group."""
    return df.withColumn("is_reverted_by_good_user", flags.overlaps(F.col(column), S.TRUSTED_GROUPS).cast("int"))


def flag_tags(df: DataFrame, column: str = "revision_tags") -> DataFrame:
    """One 0/1 column per edit tag."""
    return df.withColumns({
        name: flags.contains(F.col(column), tag).cast("int") for name, tag in zip(S.TAG_FLAGS, S.EDIT_TAGS)
    })


def flag_user_groups(
    df: DataFrame, groups: str = "event_user_groups", anonymous: str = "event_user_is_anonymous"
) -> DataFrame:
    """User features per revision: `is_anonymous` and one flag per user group."""
    return df.select(
        *S.KEYS,
        F.col(anonymous).alias(S.ANONYMOUS),
        *[flags.contains(F.col(groups), g).alias(n) for n, g in zip(S.GROUP_FLAGS, S.USER_GROUPS)],
    )


def flag_text_change(
    df: DataFrame, columns: Sequence[str] = ("texts_removed", "texts_insert", "texts_change")
) -> DataFrame:
    """`text_changes_found`: any text was removed, inserted or changed."""
    found = F.lit(False)
    for c in columns:
        found = found | flags.is_filled(F.col(c))
    return df.withColumn("text_changes_found", found)


def flag_presence(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One flag per entry `name → column`: the column is neither null nor −1."""
    return df.withColumns({
        name: F.col(c).isNotNull() & (F.col(c).cast("string") != str(S.MISSING)) & (F.col(c).cast("string") != "-1.0")
        for name, c in columns.items()
    })


def expand_actions(df: DataFrame, column: str = "actions") -> DataFrame:
    """Map of action counts → one int column per action and type, absent → 0."""
    counts = [F.coalesce(F.try_element_at(F.col(column), F.lit(n)), F.lit(0)).alias(n) for n in S.ACTION_FEATURES]
    return df.select("*", *counts)


def drop_incomplete(df: DataFrame, extra: DataFrame, keys: Sequence[str], required: Sequence[str]) -> DataFrame:
    """Adds extra features by key, keeps rows that have the required ones; a name both sides have stays the left's."""
    new = [c for c in extra.columns if c not in df.columns or c in keys]
    return df.join(extra.select(*new), list(keys), "left").dropna(subset=list(required))


def filter_funnel(df: DataFrame, revert_wars: bool = True, anonymous_only: bool = False) -> DataFrame:
    """Row counts after each filter step, in one pass over a history joined with its reverters."""
    steps = [("history", F.lit(True))]
    if revert_wars:
        steps.append(("no_revert_wars", ~flags.is_true(F.col(S.REVERTER_REVERTED))))
    steps.append(("no_bots", ~flags.is_filled(F.col("event_user_is_bot_by"))))
    steps.append(("no_new_pages", flags.is_true(F.col(S.PARENT) != 0)))
    if anonymous_only:
        steps.append(("anonymous", flags.is_true(F.col("event_user_is_anonymous"))))
    kept, counts = F.lit(True), []
    for name, step in steps:
        kept = kept & step
        counts.append(F.count_if(kept).alias(name))
    wide = df.agg(*counts)
    return wide.unpivot([], [n for n, _ in steps], "step", "row_count")
