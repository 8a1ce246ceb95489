"""Joins of revisions with texts, scores, user features and dimensions."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editlens import schema as S
from editlens.session import materialize_bucketed


def wanted_texts(
    revisions: DataFrame, wikitext: DataFrame, buckets: int, text: str = "revision_text", keys: Sequence[str] = (S.WIKI,)
) -> DataFrame:
    """The texts that revisions and their parents ask for, written in buckets by revision.

    The text table, by far the largest, moves once; a table that is bucketed already needs no such copy. With as many buckets
    as shuffle partitions each bucket is one file.
    """
    by = [*keys, S.ID]
    ids = revisions.select(*keys, F.explode(F.array(S.ID, S.PARENT)).alias(S.ID)).where(F.col(S.ID).isNotNull()).distinct()
    texts = wikitext.where(F.col(text).isNotNull()).select(*by, text)
    return materialize_bucketed(texts.join(ids, by, "left_semi"), "wanted_texts", by, buckets)


def join_revision_texts(
    revisions: DataFrame, wikitext: DataFrame, text: str = "revision_text", keys: Sequence[str] = (S.WIKI,)
) -> DataFrame:
    """Attaches each revision's own text and its parent's; keeps revisions that have both. Texts are unique by revision.

    Over a bucketed text table both lookups read it in place. The parent is looked up first, so that only its text moves, to
    the bucket of the revision; the result is dealt by revision.
    """
    by = [*keys, S.ID]
    texts = wikitext.where(F.col(text).isNotNull()).select(*by, text)
    parents = texts.withColumnsRenamed({S.ID: S.PARENT, text: "parent_text"})
    own = texts.withColumnsRenamed({text: "__text"})
    both = revisions.join(parents, [*keys, S.PARENT]).join(own, by)
    return both.select(*revisions.columns, F.col("__text").alias("revision_text"), "parent_text")


def join_wanted(table: DataFrame, wanted: DataFrame, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """Rows of a big table whose keys are wanted; the key list is broadcast only if it is small."""
    return table.join(wanted.select(*keys).distinct(), list(keys))


def join_user_features(history: DataFrame, wanted: DataFrame) -> DataFrame:
    """Anonymity and groups of the wanted revisions, one join over all wikis."""
    return join_wanted(history.select(*S.KEYS, "event_user_is_anonymous", "event_user_groups"), wanted)


def lookup_user_features(df: DataFrame, features: DataFrame) -> DataFrame:
    """Adds user features by key; revisions without them get nulls."""
    return df.join(features, S.KEYS, "left")


def lookup_scores(
    df: DataFrame,
    scores: DataFrame,
    name: str,
    score: str = "predict_score",
    keys: Sequence[str] = S.KEYS,
    order: str | None = None,
) -> DataFrame:
    """Adds one model's score by key, −1 if absent. Of several scores per key the last in `order` wins."""
    latest = F.max_by(score, order) if order else F.max(score)
    unique = scores.groupBy(*keys).agg(latest.alias("__score"))
    joined = df.join(unique, list(keys), "left")
    return joined.withColumn(name, F.coalesce(F.col("__score"), F.lit(float(S.MISSING)))).drop("__score")


def join_many_models(scores: DataFrame, models: Sequence[str], keys: Sequence[str] = S.KEYS) -> DataFrame:
    """Long scores (model, keys, score) → one column `<model>_pred` per model, in one shuffle."""
    wide = scores.groupBy(*keys).agg(*[
        F.max(F.when(F.col("model") == m, F.col("score"))).alias(f"{m}_pred") for m in models
    ])
    return wide


def semi_anti_flag(df: DataFrame, members: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """0/1 column: the row's key is in the member list."""
    marked = members.select(*keys).distinct().withColumn("__hit", F.lit(1))
    return df.join(marked, list(keys), "left").withColumn(name, F.coalesce("__hit", F.lit(0))).drop("__hit")


def top_k_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values, ties by value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("row_count"))
    return counts.orderBy(F.desc("row_count"), F.asc(column)).limit(k)


def semi_join_topk(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """Rows whose value is among the k most frequent. At most k rows are broadcast."""
    return df.join(F.broadcast(top_k_values(df, column, k).select(column)), column, "left_semi")


def join_dimension(df: DataFrame, dimension: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of a side table; Spark broadcasts it if its size allows."""
    return df.join(dimension, list(keys), "left")


def _left_join_spread(df: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """Left join on one key; rows without the key are dealt to many tasks instead of meeting in the null key's."""
    spread = F.when(F.col(key).isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(1024))).otherwise(F.lit(0))
    dealt = side.withColumn("__deal", F.lit(0).cast("long"))
    return df.withColumn("__deal", spread.cast("long")).join(dealt, [key, "__deal"], "left").select(
        *df.columns, *[c for c in side.columns if c != key]
    )


def join_page_region(df: DataFrame, regions: DataFrame, title: str = S.TITLE, region: str = "page_region") -> DataFrame:
    """Region per page, resolved once per title and mapped back; missing → `Unknown`."""
    wanted = df.select(title).distinct()
    resolved = regions.join(wanted, title, "left_semi").groupBy(title).agg(F.min(region).alias(region))
    return _left_join_spread(df, resolved, title).withColumn(region, F.coalesce(region, F.lit("Unknown")))


#: From this many low bits on, the addresses under one prefix are dealt to several tasks: twice as many per bit, up to 2^10.
SPREAD_FROM, MOST_SPREAD = 16, 10


def _spread(level: str) -> str:
    return f"shiftleft(1L, greatest(0, least({level} - {SPREAD_FROM}, {MOST_SPREAD})))"


def aligned_pieces(blocks: DataFrame, bits: int = 32) -> DataFrame:
    """Blocks [ip_start, ip_end] as rows (level, prefix, ...) of a prefix trie: the fewest aligned ranges of 2^level addresses.

    A block that is a power of two wide and aligned is one row, any other at most two per level. What lies outside of the
    addresses of so many bits is cut off; a block that ends before it starts has no rows.
    """
    low, high = "greatest(ip_start, 0L)", f"least(ip_end, {(1 << bits) - 1}L)"
    levels = F.expr(f"""transform(sequence(0, {bits}), k -> struct(
        k AS level, shiftright({low} + shiftleft(1L, k) - 1, k) AS first, shiftright({high} + 1, k) AS after))""")
    inside = blocks.where("ip_start IS NOT NULL AND ip_end IS NOT NULL")
    per_level = inside.select("*", F.inline(levels)).where(F.col("first") < F.col("after"))
    ends = F.array(F.when(F.col("first") % 2 == 1, F.col("first")), F.when(F.col("after") % 2 == 1, F.col("after") - 1))
    return per_level.select("*", F.explode(F.array_compact(ends)).alias("prefix")).drop("first", "after")


def join_ip_range(
    df: DataFrame, blocks: DataFrame, address: str, attributes: Sequence[str], bits: int = 32
) -> DataFrame:
    """Attributes of the narrowest block [ip_start, ip_end] that holds the address, ties to the lowest start; none → nulls.

    Each distinct address is resolved once: it asks for its prefix on every level of a trie that holds the blocks, so the
    work grows with addresses plus blocks, however wide blocks are or how many lie close together. The addresses under a
    wide block are dealt to many tasks, each of which gets the block.
    """
    pieces = aligned_pieces(blocks.select("ip_start", "ip_end", *attributes), bits)
    listed = pieces.select("*", F.explode(F.expr(f"sequence(0L, {_spread('level')} - 1)")).alias("__deal"))
    probes = df.where(F.col(address).isNotNull()).select(F.col(address).cast("long").alias("__address")).distinct()
    asked = probes.select("__address", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("level")).select(
        "__address", "level", F.expr("shiftright(__address, level)").alias("prefix"),
        F.expr(f"pmod(__address, {_spread('level')})").alias("__deal"),
    )
    hits = asked.join(listed, ["level", "prefix", "__deal"])
    narrowest = hits.groupBy("__address").agg(
        F.min_by(F.struct(*attributes), F.struct(F.col("ip_end") - F.col("ip_start"), "ip_start")).alias("__hit")
    )
    resolved = narrowest.select(F.col("__address").alias(address), *[F.col(f"__hit.{a}").alias(a) for a in attributes])
    return _left_join_spread(df, resolved, address)


def unpivot_scores(df: DataFrame, ids: Sequence[str], models: dict[str, str]) -> DataFrame:
    """One column per model → rows (ids, model, score) under display names."""
    entries = F.array(*[
        F.struct(F.lit(name).alias("model"), F.col(c).cast("double").alias("score")) for c, name in models.items()
    ])
    return df.select(*ids, F.inline(entries))
