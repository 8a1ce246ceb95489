"""Scans of the big tables. Filters and column lists reach the parquet scan; keep the tables partitioned by
snapshot (or year) and wiki so that whole partitions are skipped."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editlens import schema as S
from editlens.operators.revisions import filter_time_range


def scan_history(
    history: DataFrame, snapshot: str, start: str, end: str, wikis: Sequence[str] | None = None,
    columns: Sequence[str] = tuple(S.HISTORY_COLUMNS),
) -> DataFrame:
    """Article revisions of a snapshot in [start, end), for some wikis or all."""
    rows = history.where(
        (F.col("snapshot") == snapshot) & (F.col("event_entity") == "revision") & (F.col("page_namespace") == 0)
    )
    if wikis is not None:
        rows = rows.where(F.col(S.WIKI).isin(list(wikis)))
    return filter_time_range(rows, start, end).select(*columns)


def scan_wikitext(wikitext: DataFrame, snapshot: str, wikis: Sequence[str] | None = None) -> DataFrame:
    """Texts of article revisions of a snapshot."""
    rows = wikitext.where((F.col("snapshot") == snapshot) & (F.col("page_namespace") == 0))
    if wikis is not None:
        rows = rows.where(F.col(S.WIKI).isin(list(wikis)))
    return rows.select(S.ID, S.WIKI, "revision_text")


def scan_reference_scores(scores: DataFrame, year: int = 2022, model: str | None = None) -> DataFrame:
    """Score maps of the reference system for one year of article edits; with `model`, only that entry."""
    rows = scores.where((F.col("year") == year) & (F.col("page_namespace") == 0))
    value = F.col("scores") if model is None else F.map_filter("scores", lambda k, _: k == model)
    return rows.select(F.col("database").alias(S.WIKI), F.col("rev_id").alias(S.ID), value.alias("scores"))
