"""Text fragments of revisions: collecting, scoring each distinct one once, and features per revision."""

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editlens import schema as S
from editlens.functions.flags import is_filled
from editlens.functions.scores import softmax_pair
from editlens.functions.text import readable_title
from editlens.operators.revisions import filter_placeholder_text
from editlens.operators.sampling import balance_training_set

from editlens.operators.aggregates import title_stats

TEXT_COLUMNS = {
    "insert": "texts_insert", "remove": "texts_removed", "change": "texts_change", "title": S.TITLE,
    "comment": S.COMMENT,
}
FRAGMENT_COLUMNS = ["text", "text_pair"]


def fragment_digest(text: Column, pair: Column) -> Column:
    """128-bit key of a fragment or pair; joins carry it instead of the text."""
    length = F.coalesce(F.length(text), F.lit(0)).cast("string")
    return F.md5(F.concat(length, F.lit(":"), text, F.coalesce(pair, F.lit(""))).cast("binary"))


def revision_fragments(df: DataFrame, kind: str, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """Rows (keys, text, text_pair, digest), one per fragment occurrence; empty texts and unchanged pairs left out."""
    column = TEXT_COLUMNS[kind]
    none = F.lit(None).cast("string")
    if kind == "change":
        rows = df.select(*keys, F.explode(column).alias("__f")).select(
            *keys, F.col("__f.before").alias("text"), F.col("__f.after").alias("text_pair")
        ).where(F.col("text") != F.col("text_pair"))
    elif kind in ("insert", "remove"):
        rows = df.select(*keys, F.explode(column).alias("text"), none.alias("text_pair")).where(F.length("text") > 0)
    else:
        text = readable_title(F.col(column)) if kind == "title" else F.col(column)
        rows = df.select(*keys, text.alias("text"), none.alias("text_pair")).where(F.col("text").isNotNull())
    return rows.withColumn("digest", fragment_digest(F.col("text"), F.col("text_pair")))


def collect_fragments(df: DataFrame, kind: str) -> DataFrame:
    """Distinct fragments of a kind: what a text model has to score."""
    return revision_fragments(df, kind, []).select("text", "text_pair").distinct()


def sort_by_length(fragments: DataFrame, batches: int | None = None) -> DataFrame:
    """Fragments of similar length in the same partition, longest first, so that model batches pad little."""
    sized = fragments.withColumn("__len", F.length("text"))
    spread = [F.col("__len").desc(), F.xxhash64("text")]
    parts = sized.repartitionByRange(batches, *spread) if batches else sized.repartitionByRange(*spread)
    return parts.sortWithinPartitions(F.col("__len").desc()).drop("__len")


Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def score_fragments(fragments: DataFrame, scorer: Scorer, batches: int | None = None) -> DataFrame:
    """Runs a batch scorer on distinct fragments. It takes (text, text_pair) and returns columns s_0 and, if it has two
    outputs, s_1 (null otherwise)."""

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = scorer(frame[FRAGMENT_COLUMNS])
            second = out["s_1"].to_numpy() if "s_1" in out else [None] * len(out)
            yield frame[FRAGMENT_COLUMNS].assign(s_0=out["s_0"].to_numpy(), s_1=pd.Series(second, index=frame.index, dtype="float64"))

    ordered = sort_by_length(fragments.select(*FRAGMENT_COLUMNS), batches)
    return ordered.mapInPandas(score, "text string, text_pair string, s_0 double, s_1 double")


def softmax_scores(scores: DataFrame) -> DataFrame:
    """Adds probabilities `p_0`, `p_1` to raw scores `s_0`, `s_1`."""
    p0, p1 = softmax_pair(F.col("s_0"), F.col("s_1"))
    return scores.withColumns({"p_0": p0, "p_1": p1})


def _scored(fragments: DataFrame, scores: DataFrame) -> DataFrame:
    """Fragment occurrences with their scores. Only digests and numbers are joined, not texts."""
    by_digest = softmax_scores(scores).select(
        fragment_digest(F.col("text"), F.col("text_pair")).alias("digest"), "s_0", "s_1", "p_0", "p_1"
    )
    return fragments.drop("text", "text_pair").join(by_digest, "digest")


def fragment_features(
    df: DataFrame, scores: DataFrame, kind: str, keys: Sequence[str] = S.KEYS
) -> DataFrame:
    """Adds max and mean of s_0, s_1, p_0, p_1 over a revision's fragments; none → −1.

    A fragment that occurs twice in a revision counts twice in the mean.
    """
    values = ["s_0", "s_1", "p_0", "p_1"]
    per_revision = _scored(revision_fragments(df, kind, keys), scores).groupBy(*keys).agg(
        *[F.max(v).alias(f"{kind}_{v}_max") for v in values], *[F.avg(v).alias(f"{kind}_{v}_mean") for v in values]
    )
    return _filled(df.join(per_revision, list(keys), "left"), [f"{kind}_{s}" for s in S.FRAGMENT_STATS])


def _filled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(float(S.MISSING))) for c in columns})


def insert_features(df: DataFrame, scores: DataFrame, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """Eight columns from the scores of inserted texts."""
    return fragment_features(df, scores, "insert", keys)


def remove_features(df: DataFrame, scores: DataFrame, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """Eight columns from the scores of removed texts."""
    return fragment_features(df, scores, "remove", keys)


def change_features(df: DataFrame, scores: DataFrame, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """Eight columns from the scores of changed pairs."""
    return fragment_features(df, scores, "change", keys)


def title_features(df: DataFrame, scores: DataFrame) -> DataFrame:
    """Score and probability of the title. The title model has one output, whose softmax is always 1."""
    by_title = scores.select(
        fragment_digest(F.col("text"), F.lit(None).cast("string")).alias("__d"), F.col("s_0").alias("title_s_0")
    )
    keyed = df.withColumn("__d", fragment_digest(readable_title(F.col(S.TITLE)), F.lit(None).cast("string")))
    joined = keyed.join(by_title, "__d", "left").drop("__d")
    joined = joined.withColumn("title_p_0", F.when(F.col("title_s_0").isNotNull(), F.lit(1.0)))
    return _filled(joined, ["title_s_0", "title_p_0"])


def comment_features(df: DataFrame, scores: DataFrame) -> DataFrame:
    """Four columns from the score of the edit comment; none → −1."""
    none = F.lit(None).cast("string")
    by_text = softmax_scores(scores).select(
        fragment_digest(F.col("text"), none).alias("__d"),
        *[F.col(v).alias(f"comment_{v}") for v in S.COMMENT_STATS],
    )
    # Edits without a comment get a key of their own that no score has, so that they do not meet in one task.
    own = F.concat(F.lit("-"), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in S.KEYS])
    keyed = df.withColumn("__d", F.coalesce(fragment_digest(F.col(S.COMMENT), none), own))
    return _filled(keyed.join(by_text, "__d", "left").drop("__d"), S.COMMENT_FEATURES)


def text_training_set(df: DataFrame, kind: str, balance: bool = True, label: str = S.LABEL) -> DataFrame:
    """Training rows of a text model: revisions with exactly one fragment of the kind, balanced by label."""
    column = TEXT_COLUMNS[kind]
    single = df.where(is_filled(F.col(column)) & (F.size(column) == 1)).withColumn("__f", F.get(column, F.lit(0)))
    common = [F.col(label).cast("int").alias("label"), F.col(S.ID), F.col(S.WIKI).alias("lang")]
    if kind == "change":
        rows = single.select(F.col("__f.before").alias("sentence1"), F.col("__f.after").alias("sentence2"), *common)
        rows = filter_placeholder_text(rows.where("sentence1 <> sentence2"), ["sentence1", "sentence2"])
    else:
        rows = single.select(F.col("__f").alias("sentence1"), *common).where(F.length("sentence1") > 0)
        rows = filter_placeholder_text(rows, ["sentence1"])
    return balance_training_set(rows) if balance else rows


def comment_training_set(df: DataFrame, balance: bool = True, label: str = S.LABEL) -> DataFrame:
    """Training rows of the comment model: comments of more than one character."""
    rows = df.select(
        F.col(S.COMMENT).alias("sentence1"), F.col(label).cast("int").alias("label"), F.col(S.ID),
        F.col(S.WIKI).alias("lang"),
    ).where(F.length("sentence1") > 1)
    rows = filter_placeholder_text(rows, ["sentence1"], extra=["null"])
    return balance_training_set(rows) if balance else rows


def title_training_set(df: DataFrame, min_rows: int = 5) -> DataFrame:
    """Regression rows of the title model: revert rate per title with enough revisions."""
    return title_stats(df, min_rows).withColumn(S.TITLE, readable_title(F.col(S.TITLE)))
