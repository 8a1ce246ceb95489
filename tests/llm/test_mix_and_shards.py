"""Curriculum mixing and Hilbert shards."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from editlens.llm import curriculum, hilbert
from editlens.llm.common import word_count


def sized(docs):
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))


def targets_by_hand(sizes: dict) -> dict:
    """Deals the rest by weight until no source is above its limit."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        dealt = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if dealt[s] > 2 * sizes[s] + 1e-9]
        if not over:
            return fixed | dealt
        fixed |= {s: 2.0 * sizes[s] for s in over}


@pytest.mark.parametrize("whole", [False, True])
def test_targets_and_taken(awkward, whole):
    rows = curriculum.mix(sized(awkward), whole=whole).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
    want = targets_by_hand(dict(sizes))
    taken, largest = Counter(), Counter()
    assert len(rows) == awkward.count()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(i.words for i in r["items"])
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s, t in want.items():
        assert abs(taken[s] - t) <= (largest[s] / 2 + 1 if whole else 1)


def test_same_again(awkward):
    key = lambda df: Counter(map(str, df.select("doc_id", "size", "taken", "items").collect()))
    assert key(curriculum.mix(sized(awkward))) == key(curriculum.mix(sized(awkward.repartition(7))))


def test_positions_follow_the_schedule(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), F.lit(10).alias("size")
    )
    rows = curriculum.mix(docs, cycle=(1.0, 1.0), curves=((1.0, 0.0), (0.0, 1.0)), share=1.0, most=1)
    items = sorted((i.position, r.source) for r in rows.collect() for i in r["items"])
    first, last = Counter(s for _, s in items[:300]), Counter(s for _, s in items[-300:])
    assert first["a"] > 250 and last["b"] > 250
    # by time t source a has got target·(2t − t²) words and b target·t²
    at_half = [p for p, s in items if s == "a"]
    total = {s: sum(1 for _, x in items if x == s) * 10 for s in "ab"}
    k = int(len(at_half) * 0.75)  # three quarters of a's words are due at t = 1/2
    assert at_half[k] == pytest.approx(0.75 * total["a"] + 0.25 * total["b"], rel=0.02)


def test_order_is_by_position(awkward):
    mixed = curriculum.mix(sized(awkward))
    ordered = curriculum.training_order(mixed, ["doc_id"]).collect()
    want = sorted(i.position for r in mixed.collect() for i in r["items"])
    assert len(ordered) == len(want)


def test_mix_of_nothing(empty):
    assert curriculum.mix(sized(empty)).count() == 0


def test_curve_visits_neighbours(spark):
    for dims, bits in ((2, 3), (3, 2)):
        side = 1 << bits
        grid = spark.range(side**dims).select(*[(F.floor(F.col("id") / side**k) % side).cast("int").alias(f"x{k}") for k in range(dims)])
        cells = grid.withColumn("h", hilbert.curve_index([F.col(f"x{k}") for k in range(dims)], bits)).orderBy("h").collect()
        assert [c.h for c in cells] == list(range(side**dims))
        for a, b in zip(cells, cells[1:], strict=False):
            assert sum(abs(a[k] - b[k]) for k in range(dims)) == 1


def test_shards(awkward):
    rows = hilbert.shard_documents(awkward).collect()
    texts = defaultdict(list)
    for r in awkward.collect():
        raw = (r.text or "").encode()
        texts[r.doc_id].append((len(raw) + 1, zlib.crc32(raw)))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, *v) for i, vs in texts.items() for v in vs)
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(16)) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    in_order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.cell for r in in_order] == sorted(r.cell for r in rows)


def test_shards_of_nothing(empty):
    assert hilbert.shard_documents(empty).count() == 0


def test_hot_cell(spark, tmp_path):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"))
    rows = hilbert.shard_documents(docs)
    assert {r["count"] for r in rows.groupBy("shard").count().collect()} == {250}
    hilbert.write_shards(rows, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 4000
