"""Range join of addresses with blocks against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from editlens.operators import joins

BLOCKS = "ip_start long, ip_end long, country string"


def brute(address, blocks):
    if address is None or not 0 <= address < 1 << 32:
        return None
    held = [(e - s, s, c) for s, e, c in blocks if s is not None and e is not None and s <= address <= e]
    return min(held)[2] if held else None


@pytest.mark.parametrize("seed", range(3))
def test_nested_and_overlapping_blocks(spark, seed):
    rng = random.Random(seed)
    blocks = []
    for i in range(150):
        start = rng.choice([rng.randrange(1 << 32), rng.randrange(1 << 12), (1 << 32) - rng.randrange(1, 1 << 12)])
        blocks.append((start, start + rng.choice([0, 1, 2, 255, 1 << 16, 1 << 24, 1 << 30, -5]), f"c{i}"))
    blocks += [(0, (1 << 32) - 1, "all"), (10 << 24, (11 << 24) - 1, "eight"), (None, 5, "no"), (-100, 3, "below"), (0, 1 << 40, "beyond")]
    edges = [x for s, e, _ in blocks if s is not None for x in (s - 1, s, e, e + 1)]
    addresses = [None, -1, 0, (1 << 32) - 1, 1 << 32, *edges, *[rng.randrange(1 << 32) for _ in range(300)], 7, 7]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(addresses)], "id int, address long")
    got = {r.id: r.country for r in joins.join_ip_range(df, spark.createDataFrame(blocks, BLOCKS), "address", ["country"]).collect()}
    assert got == {i: brute(a, blocks) for i, a in enumerate(addresses)}


def test_pieces(spark):
    blocks = [(10 << 24, (11 << 24) - 1, "eight"), (0, (1 << 32) - 1, "all"), (5, 5, "one"), (1, (1 << 32) - 2, "odd"), (9, 8, "none")]
    pieces = joins.aligned_pieces(spark.createDataFrame(blocks, BLOCKS)).collect()
    by = {c: sorted((p.level, p.prefix) for p in pieces if p.country == c) for _, _, c in blocks}
    assert by["eight"] == [(24, 10)] and by["all"] == [(32, 0)] and by["one"] == [(0, 5)] and by["none"] == []
    assert len(by["odd"]) == 62
    covered = sorted((p.prefix << p.level, (p.prefix + 1) << p.level) for p in pieces if p.country == "odd")
    assert covered[0][0] == 1 and covered[-1][1] == (1 << 32) - 1 and all(a[1] == b[0] for a, b in zip(covered, covered[1:]))


def test_addresses_of_a_wide_block_are_dealt(spark):
    """Rows of the join grow with addresses plus blocks, and no key of it holds more than a share of a wide block."""
    df = spark.range(200_000).select(((F.lit(10) * (1 << 24)) + F.col("id") * 83).alias("address"))
    blocks = spark.createDataFrame([(10 << 24, (11 << 24) - 1, "eight")], BLOCKS)
    out = joins.join_ip_range(df, blocks, "address", ["country"])
    assert out.where("country = 'eight'").count() == 200_000
    dealt = df.groupBy(F.expr(f"pmod(address, {joins._spread('24')})")).count().agg(F.max("count")).first()[0]
    assert dealt < 2_000


def test_no_rows(spark):
    df = spark.createDataFrame([(1, None)], "id int, address long")
    blocks = spark.createDataFrame([], BLOCKS)
    assert joins.join_ip_range(df, blocks, "address", ["country"]).collect()[0].country is None
    assert joins.join_ip_range(df.limit(0), blocks, "address", ["country"]).count() == 0
