"""Samples against sorting in plain Python, on groups large enough that only a stretch of the hashes is looked at."""

import hashlib

import pytest
from pyspark.sql import functions as F

from editlens.operators import sampling as Sa

ROWS = 60_000


def digest(key):
    return hashlib.md5(f"42:{key}".encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    """Two thirds of the rows in one group, some without a group."""
    group = F.expr("CASE WHEN id % 3 < 2 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE 'other' END")
    path = str(tmp_path_factory.mktemp("sampling") / "rows")
    spark.range(ROWS).select("id", group.alias("grp"), (F.col("id") % 5 == 0).cast("int").alias("label")).write.parquet(path)
    return spark.read.parquet(path)


def ids_of(rows, group):
    return [i for i in range(ROWS) if ("hot" if i % 3 < 2 else None if i % 7 == 0 else "other") == group]


@pytest.mark.parametrize("cap", [1, 2000, 19_000])
def test_first_by_hash_in_large_groups(rows, cap):
    got = {}
    for r in Sa.sample_cap(rows, cap, ["grp"], ["id"]).collect():
        got.setdefault(r["grp"], set()).add(r["id"])
    for group in ("hot", "other", None):
        assert got[group] == set(sorted(ids_of(rows, group), key=digest)[:cap])


def test_random_split_is_exact_and_plans_without_a_job(spark, rows):
    context = spark.sparkContext
    context.setJobGroup("planning", "split")
    split = Sa.split_random(rows, 0.05, ["id"])
    assert not context.statusTracker().getJobIdsForGroup("planning")
    context.setJobGroup("run", "split")
    test = {r["id"] for r in split.where("part = 'test'").collect()}
    assert test == set(sorted(range(ROWS), key=digest)[: ROWS // 20])


def test_stratified_split_is_exact_per_label(rows):
    test = {r["id"] for r in Sa.split_stratified(rows, 0.1, "label", ["id"]).where("part = 'test'").select("id").collect()}
    for label in (0, 1):
        ids = sorted((i for i in range(ROWS) if (i % 5 == 0) == bool(label)), key=digest)
        assert {i for i in test if (i % 5 == 0) == bool(label)} == set(ids[: -(-len(ids) // 10)])


def test_few_hashes_are_ranked(rows):
    sizes = rows.groupBy("grp").agg(F.count(F.lit(1)).alias(Sa.GROUP_SIZE)).withColumn("__quota", F.lit(2000))
    bounds = {r["grp"]: (r["__low"], r["__high"]) for r in Sa._stretch(sizes, Sa.WIDTH).collect()}
    low, high = bounds["hot"]
    inside = [i for i in ids_of(rows, "hot") if low <= digest(i) <= high]
    assert 0 < len(inside) <= 25 * 2000**0.5


@pytest.mark.parametrize("width", [0.0, 0.01])
def test_quota_outside_the_stretch_goes_on_to_the_end_of_a_prefix(rows, width):
    """What repeated keys can bring about, forced by a stretch of next to no width."""
    joined, chosen = Sa.sampled(rows, ["grp"], ["id"], F.lit(2000), width=width)
    taken = {r["id"] for r in joined.where(chosen).collect() if r["grp"] == "hot"}
    in_order = sorted(ids_of(rows, "hot"), key=digest)
    assert taken == set(in_order[: len(taken)]) and 2000 <= len(taken) <= 2000 + 2 * 40_000 // 4096 + 20


def test_one_key_with_a_third_of_the_rows_is_taken_whole_or_not_at_all(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("id"), F.lit("a").alias("grp"))
    counts = Sa.sample_cap(df, 15_000, ["grp"], ["id"]).groupBy((F.col("id") == -1).alias("hot")).count().collect()
    sizes = {r["hot"]: r["count"] for r in counts}
    assert sizes.get(True, 0) in (0, 10_000) and sum(sizes.values()) >= 15_000


def test_empty_tables(rows):
    none = rows.limit(0)
    assert Sa.split_random(none, keys=["id"]).count() == 0
    assert Sa.sample_cap(none, 5, ["grp"], ["id"]).count() == 0
    assert Sa.split_stratified(none, 0.1, "label", ["id"]).count() == 0


def test_keys_are_hashed_twice_at_most(rows):
    """Once for the limits and once in the filter; group sizes need no keys."""
    for sample in (Sa.sample_cap(rows, 100, ["grp"], ["id"]), Sa.split_stratified(rows, 0.1, "label", ["id"])):
        plan = sample._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("md5(") <= 2


@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_stratified_split_leaves_rows_in_place(spark, rows, threshold):
    """Neither are the rows dealt by class, nor sent to every task; what is known of a class is."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        split = Sa.split_stratified(rows, 0.1, "label", ["id"])
        plan = split._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "BuildLeft" not in plan and plan.count("BroadcastHashJoin") == 2
