"""Document fingerprints from closed syncmers.

The alphabet is words (runs longer than 12 code points are cut into pieces, so that scripts without blanks work too). A
k-mer of five words is chosen if the least of its four inner word pairs, by hash, is the first or the last one. The choice
depends on nothing outside the five words, so equal passages give equal anchors wherever they stand. A fingerprint is the
128 least distinct anchor hashes.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from editlens.llm.common import let
from editlens.session import materialize

PIECE = r"[^\x20\x09-\x0D]{1,12}"
K = 5
KEEP = 128


def _pieces(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0)), lambda p: F.xxhash64(p))


def _chosen(pieces: Column, make) -> Column:
    """`make(first pair's hash, k-mer hash, place)` for the syncmers among the pieces."""
    def pick(w: Column) -> Column:
        pairs = F.transform(w, lambda a, i: F.xxhash64(a, F.get(w, i + 1)))
        def at(p: Column) -> Column:
            starts = F.when(F.size(w) >= K, F.sequence(F.lit(0), F.size(w) - K)).otherwise(F.array().cast("array<int>"))
            edge = lambda i: F.least(F.get(p, i), F.get(p, i + (K - 2)))
            inner = lambda i: F.least(*[F.get(p, i + j) for j in range(1, K - 2)])
            found = F.transform(
                F.filter(starts, lambda i: edge(i) <= inner(i)),
                lambda i: make(F.xxhash64(F.get(p, i), F.get(p, i + 2), F.get(w, i + 4)), i),
            )
            short = F.array(make(F.aggregate(w, F.lit(0).cast("long"), lambda a, b: F.xxhash64(a, b)), F.lit(0)))
            return F.when((F.size(w) > 0) & (F.size(w) < K), short).otherwise(found)
        return let(pairs, at)
    return let(pieces, pick)


def anchors(text: Column) -> Column:
    """Closed syncmers of a text as array<struct<hash, place>>, in text order; place counts pieces from 0.

    A text with one to four pieces has one anchor, the hash of all; a null or blank one has none.
    """
    return _chosen(_pieces(text), lambda h, i: F.struct(h.alias("hash"), i.alias("place")))


def matches(a: Column, b: Column) -> Column:
    """Places of equal anchors in two anchor arrays: array<struct<hash, place, other>>, the first place in `b` each."""
    return let(F.map_from_entries(F.array_distinct(F.array_sort(
        F.transform(F.array_distinct(F.transform(b, lambda y: y["hash"])), lambda h: F.struct(h.alias("hash"), F.get(
            F.filter(b, lambda y: y["hash"] == h), F.lit(0))["place"].alias("place")))
    ))), lambda places: F.filter(
        F.transform(a, lambda x: F.struct(x["hash"], x["place"], F.element_at(places, x["hash"]).alias("other"))),
        lambda m: m["other"].isNotNull(),
    ))


def sketch(text: Column, keep: int = KEEP) -> Column:
    """The `keep` least distinct anchor hashes (their lower 32 bits) of a text, sorted."""
    low = _chosen(_pieces(text), lambda h, i: h.bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.slice(F.sort_array(F.array_distinct(low)), 1, keep)


def as_text(sketch_column: Column) -> Column:
    return F.array_join(F.transform(sketch_column, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def likeness(a: Column, b: Column, keep: int = KEEP) -> Column:
    """Share of the least hashes of both that both have, 0 to 1; two empty sketches are alike."""
    least = F.slice(F.sort_array(F.array_union(a, b)), 1, keep)
    both = F.size(F.array_intersect(F.array_intersect(least, a), b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.size(least))


def _id_bucket(docs: DataFrame, rows_per_bucket: int) -> Column:
    """A number that rises with doc_id and has about so many rows per value: quantiles, each cut evenly. Null: -1."""
    n, low, high = docs.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        return F.lit(-1).cast("long")
    coarse = max(1, min(256, n // rows_per_bucket))
    fine = max(1, -(-n // (coarse * rows_per_bucket)))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / coarse for i in range(1, coarse)] or [0.5], 10_000)).first()[0]
    starts = [low, *sorted(set(cuts) - {low})] if coarse > 1 else [low]
    ends = [*starts[1:], high + 1]
    pick = lambda values, i: F.get(F.array(*[F.lit(int(v)) for v in values]).cast("array<bigint>"), i)
    at = F.size(F.filter(F.array(*[F.lit(int(v)) for v in starts]).cast("array<bigint>"), lambda s: s <= F.col("doc_id"))) - 1
    inside = F.floor((F.col("doc_id") - pick(starts, at)) / (pick(ends, at) - pick(starts, at)) * fine)
    return F.coalesce(at * fine + F.least(inside, F.lit(fine - 1)), F.lit(-1)).cast("long")


def with_next(docs: DataFrame, payload: Column, rows_per_bucket: int = 4096) -> DataFrame:
    """doc_id, text, `own` (the payload) and those of the next row by ascending doc_id as `next_text`, `next_own`.

    The last row's next is the first. Null ids come first; rows with equal ids follow their texts. Rows are dealt by
    ranges of ids; only the first row of each range is looked up from the range before, so no task sees all rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("text")).withColumn("__bucket", _id_bucket(docs.select("doc_id"), rows_per_bucket))
    order = Window.partitionBy("__bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    rows = base.withColumn("own", payload)
    following = F.lead(F.struct("text", "own")).over(order)

    firsts = materialize(base.groupBy("__bucket").agg(F.min("doc_id").alias("__id")), "firsts")
    heads = (
        base.join(firsts.withColumnRenamed("__bucket", "__b"), (F.col("__bucket") == F.col("__b")) & F.col("doc_id").eqNullSafe(F.col("__id")))
        .groupBy("__bucket").agg(F.min("text").alias("text")).withColumn("__own", payload)
    )
    ring = Window.orderBy("__bucket")  # one narrow row per range of ids
    before = firsts.select(
        "__bucket", F.coalesce(F.lag("__bucket").over(ring), F.max("__bucket").over(Window.partitionBy())).alias("__of")
    )
    looked = before.join(heads, "__bucket").select(
        F.col("__of").alias("__bucket"), F.struct(F.col("text").alias("text"), F.col("__own").alias("own")).alias("__head")
    )
    led = rows.withColumn("__next", following)
    ends = F.coalesce(F.col("__next"), F.col("__head"))
    return led.join(looked, "__bucket").select(
        "doc_id", "text", "own", ends["text"].alias("next_text"), ends["own"].alias("next_own")
    )


def fingerprints(docs: DataFrame, keep: int = KEEP) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, with their likeness.

    The edited text has its last half (rounded down) replaced by the first as many code points of the next document.
    A null text counts as empty. Extra columns are left out; an empty table gives an empty result.
    """
    pairs = with_next(docs.select("doc_id", "text"), sketch(F.col("text"), keep))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half))
    rows = pairs.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "own", "next_own")
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("edited"), keep).alias("other"), "own", "next_own")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("other")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("other"), keep).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own"), keep).alias("near_next"),
    )
