"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised to a few bits each, a row's cell is its index on the Hilbert curve through that
grid, and shards are runs of equal row counts along the curve. Neighbours on the curve are neighbours in every
dimension, so each shard covers a small box and a filter on any dimension can skip files by their minima and maxima.

Ranks are sums over cells, over parts of a cell, and row numbers within a part; a cell with a third of all rows is cut
into up to 4,096 parts by text hash and id hash.
"""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from editlens.session import materialize

LAW = "rows"


def text_code(text: Column, n_bytes: int = 6) -> Column:
    """The first bytes of a string as a number that sorts like the string; null: -1."""
    head = F.substring(text.cast("binary"), 1, n_bytes)
    return F.coalesce(F.conv(F.rpad(F.hex(head), 2 * n_bytes, "0"), 16, 10).cast("long"), F.lit(-1))


def _below(edges: Column, value: Column) -> Column:
    return F.size(F.filter(edges, lambda e: e < value))


def quantise(rows: DataFrame, codes: Mapping[str, str], bits: int = 5) -> DataFrame:
    """Replaces each code column by a level of `bits` bits with about equal row counts. Equal codes share a level.

    The cut points, 2^bits - 1 per dimension, are fetched once and are constants from then on.
    """
    n = 1 << bits
    shares = [i / n for i in range(1, n)]
    cuts = rows.agg(*[F.percentile_approx(c, shares, 10_000).alias(c) for c in codes]).first()
    out = rows
    for c, level in codes.items():
        edges = F.array(*[F.lit(int(e)) for e in cuts[c] or []]).cast("array<bigint>")
        out = out.withColumn(level, _below(edges, F.col(c)))
    return out


def _turns(dims: int) -> tuple[list[int], list[int]]:
    """Per state of the curve and corner of a cell: which place the corner has, and the state inside it.

    A state is the corner where the curve enters and the axis along which it leaves. Corners in curve order follow a
    Gray code, rotated and mirrored by the state.
    """
    full = (1 << dims) - 1
    rotate = lambda b, k: ((b >> k % dims) | (b << (dims - k % dims))) & full
    ones = lambda i: (i ^ (i + 1)).bit_length() - 1  # noqa: E731  trailing ones
    place_of = {i ^ (i >> 1): i for i in range(full + 1)}
    places, states = [], []
    for state in range(dims << dims):
        enter, axis = state % (full + 1), state // (full + 1)
        for corner in range(full + 1):
            at = place_of[rotate(corner ^ enter, axis + 1)]
            start = 0 if at == 0 else (lambda k: k ^ (k >> 1))(2 * ((at - 1) // 2))
            along = 0 if at == 0 else ones(at - 1 + at % 2) % dims
            inner = enter ^ rotate(start, dims - (axis + 1) % dims)
            places.append(at)
            states.append(inner + (axis + along + 1) % dims * (full + 1))
    return places, states


def curve_index(levels: list[Column], bits: int) -> Column:
    """Position on the Hilbert curve through the grid of these coordinates, read off bit by bit from the highest."""
    dims = len(levels)
    places, states = (F.array(*[F.lit(v) for v in t]) for t in _turns(dims))
    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("state"))

    def step(at: Column, bit: Column) -> Column:
        corner = sum(
            (F.when(v.cast("int").bitwiseAND(bit) != 0, 1 << k).otherwise(0) for k, v in enumerate(levels)), F.lit(0)
        )
        entry = at["state"] * (1 << dims) + corner
        return F.struct(
            (at["index"] * (1 << dims) + F.get(places, entry)).cast("long").alias("index"),
            F.get(states, entry).alias("state"),
        )

    walk = F.array(*[F.lit(1 << b) for b in range(bits - 1, -1, -1)])
    return F.aggregate(walk, start, step)["index"]


def shard(
    rows: DataFrame, levels: list[str], tie: list[str], bits: int = 5, shards: int = 16, parts: tuple[str, str] = ("text_crc32", "doc_id")
) -> DataFrame:
    """Adds `cell`, `shard` and `slot` (gapless from 0 in each shard). Row counts of shards differ by one at most.

    Within a cell, rows follow 64 ranges of the first `parts` column (a 32-bit hash, so equal texts stay together),
    64 hash values of the second, then the `tie` columns. Rows that tie in all of them may swap slots. Null columns
    are values like others. With fewer rows than shards some shards stay empty; an empty table gives an empty result.
    """
    part = F.shiftright(F.col(parts[0]), 26) * 64 + F.pmod(F.xxhash64(parts[1]), F.lit(64))
    celled = rows.withColumn("cell", curve_index([F.col(c) for c in levels], bits)).withColumn("__part", part.cast("int"))
    counts = celled.groupBy("cell", "__part").agg(F.count(F.lit(1)).alias("__n"))
    cells = counts.groupBy("cell").agg(F.sum("__n").alias("__rows"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # one row per cell of the grid
    cells = cells.select(
        "cell", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__first"),
        F.sum("__rows").over(Window.partitionBy()).alias("__all"),
    )
    inside = Window.partitionBy("cell").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "cell", "__part", F.coalesce(F.sum("__n").over(inside), F.lit(0)).alias("__before")
    ).join(cells, "cell").select("cell", "__part", (F.col("__first") + F.col("__before")).alias("__offset"), "__all")
    row = F.row_number().over(Window.partitionBy("cell", "__part").orderBy(*tie)) - 1
    ranked = celled.withColumn("__row", row).join(offsets, ["cell", "__part"])
    rank = F.col("__row") + F.col("__offset")
    at = F.expr(f"CAST((__rank * {shards}) DIV __all AS INT)")
    slot = F.expr(f"__rank - (CAST(shard AS BIGINT) * __all + {shards - 1}) DIV {shards}")
    return (
        ranked.withColumn("__rank", rank.cast("long")).withColumn("shard", at).withColumn("slot", slot)
        .select(*rows.columns, "cell", "shard", "slot")
    )


def shard_documents(docs: DataFrame, bits: int = 5, shards: int = 16) -> DataFrame:
    """Documents' ids with `size` (UTF-8 bytes and one more), `text_crc32`, quantised metadata, cell, shard and slot.

    A null text counts as empty. The narrow table of ids and codes is written once; texts are read once.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        text_code(F.col("lang")).alias("code_lang"), text_code(F.col("source")).alias("code_source"),
    )
    rows = materialize(narrow, "hilbert").withColumn("code_size", F.col("size"))
    codes = {c: c.replace("code", "level") for c in ("code_lang", "code_source", "code_size")}
    return shard(quantise(rows, codes, bits), list(codes.values()), ["text_crc32", "doc_id", "size"], bits, shards)


def write_shards(rows: DataFrame, path: str) -> None:
    """One folder per shard, rows in curve order inside, so that files carry tight minima and maxima."""
    rows.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
