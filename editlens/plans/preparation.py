"""Preparation job: collected revisions → train and test sets, balanced and split by title."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editlens import schema as S
from editlens.operators.revisions import filter_revert_wars
from editlens.operators.sampling import balance_flag, split_by_time, split_by_title
from editlens.session import materialize


def train_and_test(
    collected: DataFrame, cut: str, share: float = 0.6, drop_revert_wars: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Train rows (with `is_text_train`) and test rows, each with `is_balanced` per wiki."""
    rows = filter_revert_wars(collected) if drop_revert_wars else collected
    flagged = balance_flag(split_by_time(rows, cut), (S.WIKI, "part"))
    flagged = materialize(flagged, "balanced")
    train = split_by_title(flagged.where(F.col("part") == "train"), share)
    return train.drop("part"), flagged.where(F.col("part") == "test").drop("part")


def full_test(collected: DataFrame, drop_revert_wars: bool = True) -> DataFrame:
    """The independent test set: no time split, balanced per wiki."""
    return balance_flag(filter_revert_wars(collected) if drop_revert_wars else collected)
