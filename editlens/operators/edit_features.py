"""Extra features of an edit for the stacking model: its user's and its page's past, and what its text and its parent's hold.

The past is counted in two levels, per day and within a day, so that no task sees the whole history of a busy user or page.
Texts are counted once each; edits look up their own text's counts and their parent's, never the texts.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from editlens import schema as S
from editlens.operators.elements import values_of, with_link_types
from editlens.operators.markup import bracketed_elements

DAY = 86_400
USER = "event_user_text_historical"
#: Counts of a text's elements and how many of each, or of characters, make a full page.
FULL_PAGE = {"text_length": 10_000, "reference_count": 10, "wikilink_count": 20, "category_count": 5, "media_count": 3, "heading_count": 5}
#: Quality scores fall into this many equal ranges.
RANGES = 6


def with_past(df: DataFrame, keys: Sequence[str], time: str, tie: str, prefix: str) -> DataFrame:
    """Adds to each row what its key did up to it: `<prefix>_n` rows so far (this one included), `<prefix>_age` seconds since the
    first, and `<prefix>_since` seconds since the one before.

    Rows of one second are in the order of `tie`. Rows without time or with a null key have nulls and go to no group.
    """
    keys, seconds = list(keys), F.unix_seconds(F.col(time).cast("timestamp"))
    known = F.lit(True)
    for c in (*keys, time):
        known = known & F.col(c).isNotNull()
    rows = df.where(known).withColumns({"__s": seconds, "__day": F.floor(seconds / DAY)})
    days = rows.groupBy(*keys, "__day").agg(F.count(F.lit(1)).alias("__n"), F.min("__s").alias("__first"), F.max("__s").alias("__last"))
    order = Window.partitionBy(*keys).orderBy("__day")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    past = days.select(
        *keys, "__day", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
        F.min("__first").over(order).alias("__first"), F.max("__last").over(earlier).alias("__last"),
    )
    same_day = Window.partitionBy(*keys, "__day").orderBy("__s", tie)
    numbered = rows.withColumns({"__place": F.row_number().over(same_day), "__lag": F.lag("__s").over(same_day)})
    found = numbered.join(past, [*keys, "__day"]).select(
        *df.columns, (F.col("__before") + F.col("__place")).alias(f"{prefix}_n"), (F.col("__s") - F.col("__first")).alias(f"{prefix}_age"),
        (F.col("__s") - F.coalesce("__lag", "__last")).alias(f"{prefix}_since"),
    )
    none = F.lit(None).cast("long")
    unknown = df.where(~known).select(*df.columns, *[none.alias(f"{prefix}_{c}") for c in ("n", "age", "since")])
    return found.unionByName(unknown)


def content_counts(
    texts: DataFrame, text: str = "revision_text", keys: Sequence[str] = S.KEYS, aliases: DataFrame | None = None
) -> DataFrame:
    """Per text its bytes, characters, references, links, categories, media and headings, and a quality score from 0 to 1.

    The score is the mean of how far each count goes towards that of a full page. Rows without a text are left out.
    """
    rows = texts.where(F.col(text).isNotNull()).select(*keys, text, bracketed_elements(F.col(text)).alias("__found"))
    scanned = with_link_types(rows, aliases, "__types")
    of = lambda kind: F.size(values_of(kind, F.col("__found"), F.col("__types"))).cast("long")
    counted = scanned.select(
        *keys, F.octet_length(text).cast("long").alias("revision_text_bytes"), F.char_length(text).cast("long").alias("text_length"),
        of("Reference").alias("reference_count"), of("Wikilink").alias("wikilink_count"), of("Category").alias("category_count"),
        of("Media").alias("media_count"), F.regexp_count(text, F.lit(r"(?m)^=+[^=\n]+=+")).cast("long").alias("heading_count"),
    )
    score: Column = F.lit(0.0)
    for name, full in FULL_PAGE.items():
        score = score + F.least(F.col(name) / F.lit(float(full)), F.lit(1.0))
    return counted.withColumn("quality_score", score / len(FULL_PAGE))


def _range(score: str) -> Column:
    return F.least(F.floor(F.col(score) * RANGES), F.lit(RANGES - 1)).cast("long")


def edit_features(history: DataFrame, content: DataFrame) -> DataFrame:
    """The key and the 26 extra features of every revision, null where what they come from is missing.

    `content` holds `content_counts` of revisions and parents.
    """
    narrow = history.select(
        *S.KEYS, S.PARENT, S.TITLE, S.TIMESTAMP, USER, "revision_text_bytes_diff",
        F.coalesce(F.array_join("event_user_groups", ","), F.lit("")).alias("user_groups"),
        F.col("event_user_is_anonymous").alias("user_is_anonymous"), F.col(S.COMMENT).isNotNull().alias("has_comment"),
    )
    users = with_past(narrow, [S.WIKI, USER], S.TIMESTAMP, S.ID, "user")
    pages = with_past(users, [S.WIKI, S.TITLE], S.TIMESTAMP, S.ID, "page")
    counts = [*FULL_PAGE, "quality_score"]
    parents = content.select(F.col(S.WIKI), F.col(S.ID).alias("__parent"), *[F.col(c).alias(f"parent_{c}") for c in counts])
    # Without a parent a row asks for an id of its own that no text has, so that such rows do not meet.
    asked = pages.withColumn("__parent", F.when(F.col(S.PARENT) > 0, F.col(S.PARENT)).otherwise(-F.col(S.ID)))
    both = asked.join(content, S.KEYS, "left").join(parents, [S.WIKI, "__parent"], "left")
    derived = both.withColumnsRenamed({"user_n": "user_revision_count", "page_since": "page_seconds_since_previous_revision"}).withColumns({
        "quality_change": F.col("quality_score") - F.col("parent_quality_score"), "quality_range": _range("quality_score"),
        "quality_change_range": _range("quality_score") - _range("parent_quality_score"),
    })
    return derived.select(*S.KEYS, *S.EXTRA_FEATURES)
