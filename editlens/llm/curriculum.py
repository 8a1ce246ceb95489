"""Mixing sources to target weights by a curriculum that changes over training time.

Every source has a weight schedule over training time 0 … 1. Its integral, scaled to the words the source owes, is the
source's cumulative demand. A document that covers the words [start, start + size) of its source is due at the time when
the demand reaches `start`; the position is what all sources together have been asked for by then. Sorting by position
gives the training order.

Prefix sums run over (source, hash bucket) groups and then over bucket totals, so a source with a third of all rows is
spread over the cluster. Only one row per source meets in one task.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from editlens.functions.hashing import hash_order

#: Weights that sources take in turn, by code point of their name.
CYCLE = (5, 2, 1)
#: Relative weight at equally spaced times, in turn likewise: strong sources come in early, weak ones late. Each
#: schedule integrates to 1, so it moves words in time and leaves the weights as they are.
CURVES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))


def source_key(source: Column) -> Column:
    """A key that is never null, so that the rows without a source form one group of their own in plain equi joins."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def weigh(sources: DataFrame, cycle: Sequence[float] = CYCLE, curves=CURVES) -> DataFrame:
    """Adds `weight` and `curve` by the rank of the source's name, null last. One row per source comes in."""
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    pick = lambda values: F.get(F.array(*values), turn % len(values))
    return sources.select(
        "*",
        pick([F.lit(float(w)) for w in cycle]).alias("weight"),
        pick([F.array(*[F.lit(float(v)) for v in c]) for c in curves]).alias("curve"),
    )


def set_targets(sources: DataFrame, share: float = 1.5, most: int = 2) -> DataFrame:
    """Adds `target`: `share` of all words dealt by weight, none above `most` times its source.

    Sources fill up in order of limit / weight. With those before a source at their limits, the rest per unit of weight
    either lifts it over its own limit too, or is the level of all that follow.
    """
    limit = F.col("source_size") * float(most)
    by_limit = Window.orderBy(limit / F.col("weight"), "source_key")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    owed = F.sum("source_size").over(everything) * share - F.coalesce(F.sum(limit).over(before), F.lit(0.0))
    level = sources.withColumn("__level", owed / F.sum("weight").over(onward))
    full = F.col("__level") >= limit / F.col("weight")
    common = F.max(F.when(~full, F.col("__level"))).over(everything)
    return level.withColumn("target", F.when(full, limit).otherwise(F.col("weight") * common)).drop("__level")


def _segments(curve: Column, knots: int) -> Column:
    """The schedule's pieces: start time, weights at both ends, and the share of the integral before it."""
    h = 1.0 / (knots - 1)
    area = lambda i: (F.get(curve, i) + F.get(curve, i + 1)) * (h / 2)
    total = sum((area(F.lit(i)) for i in range(knots - 1)), F.lit(0.0))
    pieces, done = [], F.lit(0.0)
    for i in range(knots - 1):
        pieces.append(F.struct(
            F.lit(i * h).alias("at"), (F.get(curve, F.lit(i)) / total).alias("w0"),
            (F.get(curve, F.lit(i + 1)) / total).alias("w1"), done.alias("before"),
        ))
        done = done + area(F.lit(i)) / total
    return F.array(*pieces)


def _invert(segments: Column, share: Column, h: float) -> Column:
    """The time at which the integral reaches `share`: a quadratic within one piece."""
    piece = F.element_at(F.filter(segments, lambda s: s["before"] <= share), -1)
    gap = (share - piece["before"]) / h
    root = F.sqrt(F.greatest(piece["w0"] * piece["w0"] + 2 * (piece["w1"] - piece["w0"]) * gap, F.lit(0.0)))
    inside = F.coalesce(2 * gap / F.nullif(piece["w0"] + root, F.lit(0.0)), F.lit(0.0))
    return piece["at"] + F.least(inside, F.lit(1.0)) * h


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    size_column: str = "size",
    source_column: str = "source",
    cycle: Sequence[float] = CYCLE,
    curves=CURVES,
    share: float = 1.5,
    most: int = 2,
    bucket_digits: int = 3,
    whole: bool = False,
) -> DataFrame:
    """All rows of `docs` with `source_size`, `target`, `taken` and `items`, one (position, words) for each use.

    `taken` counts the words of all uses. The use in which a source's demand ends is cut there; with `whole` it counts
    in full if at least half of it is asked for, else not at all. Every column of `docs` is carried along; names that
    clash with the added ones are the caller's to drop. A null size counts as 0. Rows without a source are a source of
    their own. Rows that are equal in every column may swap places, which changes no result. Documents without words
    are never taken. An empty table gives an empty result.
    """
    knots = len(curves[0])
    size = F.coalesce(F.col(size_column), F.lit(0)).cast("long")
    order = hash_order(id_column)
    keyed = docs.select(
        "*", source_key(F.col(source_column)).alias("__source"), F.substring(order, 1, bucket_digits).alias("__bucket"),
        order.alias("__order"), size.alias("__size"),
    )
    totals = keyed.groupBy("__source", "__bucket").agg(F.sum("__size").alias("__words"))
    sources = totals.groupBy(F.col("__source").alias("source_key")).agg(F.sum("__words").alias("source_size"))
    named = sources.withColumn("source", F.when(F.col("source_key") != "", F.expr("substring(source_key, 2)")))
    planned = set_targets(weigh(named, cycle, curves), share, most)
    demand = [
        r[0] for r in planned.select(F.posexplode(_segments(F.col("curve"), knots)), "target")
        .groupBy("pos").agg(
            F.struct(
                F.sum(F.col("target") * F.col("col.w0")).alias("w0"), F.sum(F.col("target") * F.col("col.w1")).alias("w1"),
                F.sum(F.col("target") * F.col("col.before")).alias("before"), F.max("col.at").alias("at"),
            ).alias("s")
        ).orderBy("pos").select("s").collect()
    ]
    if not demand:
        return docs.select(
            "*", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"),
            F.expr("CAST(array() AS array<struct<position:double,words:bigint>>)").alias("items"),
        )
    earlier = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "__source", "__bucket", F.coalesce(F.sum("__words").over(earlier), F.lit(0)).alias("__offset")
    ).join(
        planned.select(
            F.col("source_key").alias("__source"), "source_size", "target", _segments(F.col("curve"), knots).alias("__curve")
        ),
        "__source",
    )
    within = (
        Window.partitionBy("__source", "__bucket").orderBy("__order", "__size").rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = keyed.withColumn("__start", F.coalesce(F.sum("__size").over(within), F.lit(0)))
    placed = placed.join(offsets, ["__source", "__bucket"]).withColumn("__start", F.col("__start") + F.col("__offset"))

    h = 1.0 / (knots - 1)
    quota = F.floor("target")
    starts = [F.col("__start") + F.col("source_size") * k for k in range(most)]
    if whole:
        takes = [F.when(F.col("__size") <= 2 * (quota - s), F.col("__size")).otherwise(0) for s in starts]
    else:
        takes = [F.least(F.greatest(quota - s, F.lit(0)), F.col("__size")) for s in starts]
    takes = [t.cast("long") for t in takes]
    overall = F.array(*[
        F.struct(*[F.lit(float(d[n])).alias(n) for n in ("w0", "w1", "before", "at")]) for d in demand
    ])

    def position(start: Column) -> Column:
        time = F.least(_invert(F.col("__curve"), start / F.col("target"), h), F.lit(1.0))
        piece = F.element_at(F.filter(overall, lambda s: s["at"] <= time), -1)
        u = (time - piece["at"]) / h
        return piece["before"] + h * (piece["w0"] * u + (piece["w1"] - piece["w0"]) * u * u / 2)

    uses = F.array(*[
        F.when(t > 0, F.struct(position(s).alias("position"), t.alias("words"))) for s, t in zip(starts, takes, strict=True)
    ])
    return placed.select(
        *[F.col(c) for c in docs.columns], "source_size", "target", sum(takes, F.lit(0).cast("long")).alias("taken"),
        F.filter(uses, lambda u: u.isNotNull()).alias("items"),
    )


def training_order(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per use of a document, range-sorted by position: the order in which training reads them."""
    rows = mixed.select(*columns, F.explode("items").alias("__item"))
    return rows.orderBy(F.col("__item.position"), *[c for c in columns[:1]]).select(*columns)
