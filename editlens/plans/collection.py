"""Collection job: history → labelled, filtered, flagged revisions → text differences."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editlens import schema as S
from editlens.operators import diff, elements, joins, revisions
from editlens.operators.sampling import sample_cap
from editlens.session import materialize, materialize_bucketed
from editlens.sources.tables import scan_history, scan_wikitext


@dataclass(frozen=True)
class CollectionSettings:
    """What to collect. One job covers all wikis."""

    snapshot: str = "2022-07"
    text_snapshot: str = "2022-11"
    start: str = "2022-01-01"
    end: str = "2022-08-01"
    window: tuple[str, str] | None = None
    revert_lookup: str = "full"
    wikis: tuple[str, ...] | None = None
    drop_revert_wars: bool = False
    anonymous_only: bool = False
    max_rows_per_wiki: int | None = None
    #: Buckets of the text table, if it is bucketed by wiki and revision.
    text_buckets: int | None = None


def filtered_revisions(history: DataFrame, settings: CollectionSettings = CollectionSettings()) -> DataFrame:
    """Revisions with label, reverter facts and tag flags, after all filters and the cap per wiki.

    `window` narrows the rows (test mode). Reverters are looked up in the whole scan, or with
    `revert_lookup="window"` only among the narrowed rows.
    """
    scanned = scan_history(history, settings.snapshot, settings.start, settings.end, settings.wikis)
    rows = revisions.filter_time_range(scanned, *settings.window) if settings.window else scanned
    candidates = rows if settings.revert_lookup == "window" else scanned
    rows = revisions.fill_null_flag(revisions.join_reverting_revision(revisions.cast_label(rows), candidates))
    if settings.drop_revert_wars:
        rows = revisions.filter_revert_wars(rows)
    rows = revisions.filter_new_pages(revisions.filter_bots(rows))
    if settings.anonymous_only:
        rows = revisions.filter_anonymous(rows)
    rows = revisions.flag_tags(revisions.flag_trusted_reverter(rows)).select(*S.COLLECTED_COLUMNS)
    if settings.max_rows_per_wiki is not None:
        # The cap reads its input more than once; a written copy spares the self join.
        rows = sample_cap(materialize(rows, "revisions"), settings.max_rows_per_wiki)
    return rows


def text_differences(
    filtered: DataFrame, wikitext: DataFrame, settings: CollectionSettings = CollectionSettings(),
    aliases: DataFrame | None = None,
) -> DataFrame:
    """Filtered revisions that have both texts, with removed, inserted and changed texts and action counts.

    Texts and their scan are written once in buckets by revision; both differences and the last join start from there.
    """
    filtered = materialize(filtered, "filtered")
    texts = scan_wikitext(wikitext, settings.text_snapshot, settings.wikis)
    buckets = settings.text_buckets
    if buckets is None:
        buckets = int(filtered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        texts = joins.wanted_texts(filtered, texts, buckets)
    both = joins.join_revision_texts(filtered.select(*S.KEYS, S.PARENT), texts).drop(S.PARENT)
    both = materialize_bucketed(elements.scan_brackets(both), "revision_texts", S.KEYS, buckets)
    sentences = diff.diff_lines(both, dealt=True)
    actions = elements.edit_action_counts(both, aliases=aliases, dealt=True)
    kept = filtered.join(both.select(*S.KEYS), S.KEYS)
    return diff.diff_or_empty(kept, sentences.join(actions, S.KEYS, "full_outer"))


def collect(
    history: DataFrame, wikitext: DataFrame, settings: CollectionSettings = CollectionSettings(), aliases: DataFrame | None = None
) -> DataFrame:
    """The whole job."""
    return text_differences(filtered_revisions(history, settings), wikitext, settings, aliases)


def revert_overview(history: DataFrame, keys: tuple[str, ...] = (S.WIKI,)) -> DataFrame:
    """Rows, revert rate and trusted-reverter rate per wiki after all filters."""
    rows = revisions.join_reverting_revision(revisions.cast_label(history), history)
    rows = revisions.filter_revert_wars(revisions.fill_null_flag(rows))
    rows = revisions.filter_new_pages(revisions.filter_bots(rows))
    rows = revisions.flag_trusted_reverter(rows)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.avg(S.LABEL).alias("revert_rate"),
        F.avg("is_reverted_by_good_user").alias("trusted_rate"),
    )
