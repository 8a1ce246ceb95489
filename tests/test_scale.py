"""The ways taken for large groups give the same rows as the ways for small ones, and as plain Python."""

import hashlib
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from editlens.operators import metrics as M
from editlens.operators import sampling as Sa
from editlens.operators import scale


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        # One group holds most rows; another has one class only; a third has ties only.
        group = "hot" if i % 3 else ("one_class" if i % 2 else "ties")
        score = 0.5 if group == "ties" else (rng.random() ** 8 if rng.random() < 0.7 else rng.randint(0, 9) / 10)
        label = 1 if group == "one_class" else int(rng.random() < 0.3)
        rows.append((i, group, label, None if i % 97 == 0 else score))
    return spark.createDataFrame(rows, "id long, grp string, label int, score double").cache()


def groups_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["grp"], []).append((r["label"], -1.0 if r["score"] is None else r["score"]))
    return out


def brute_auc(rows):
    pos = np.array([s for y, s in rows if y == 1])
    neg = np.array([s for y, s in rows if y == 0])
    if not len(pos) or not len(neg):
        return None
    return float(((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg)))


def brute_curve(rows):
    p = sum(y for y, _ in rows)
    points = []
    for t in sorted({s for _, s in rows}):
        flagged = [y for y, s in rows if s >= t]
        points.append((t, sum(flagged) / len(flagged), sum(flagged) / p))
    return points


def test_metrics_against_brute_force(scored):
    got = {r["grp"]: r for r in M.metric_table(scored, ["grp"], "label").collect()}
    for group, rows in groups_of(scored).items():
        curve = brute_curve(rows)
        auc = brute_auc(rows)
        assert got[group]["auc"] == (None if auc is None else pytest.approx(auc, abs=1e-9))
        at = max((t, p) for t, p, r in curve if r > 0.75)[1]
        assert got[group]["precision_at_recall"] == pytest.approx(at, abs=1e-9)
        area, before = 0.0, (1.0, 0.0)
        for _, p, r in reversed(curve):
            area += (r - before[1]) * (p + before[0]) / 2
            before = (p, r)
        assert got[group]["pr_auc"] == pytest.approx(area, abs=1e-9)


def test_envelope_never_falls(scored):
    rows = M.pr_envelope(scored, ["grp"], "label").where("threshold is not null").collect()
    for group in {r["grp"] for r in rows}:
        line = [(r["threshold"], r["precision"]) for r in rows if r["grp"] == group]
        values = [p for _, p in sorted(line)]
        assert values == sorted(values)
        curve = brute_curve(groups_of(scored)[group])
        assert values == pytest.approx(list(np.maximum.accumulate([p for _, p, _ in curve])))


def test_buckets_rise_with_values(spark):
    values = [None, float("-inf"), -1e300, -3.5, -3.0, -1e-300, -0.0, 0.0, 5e-324, 1e-9, 0.3, 0.3001, 0.5, 1.0, 7.0, 1e300, float("inf"), float("nan")]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    buckets = [r[0] for r in rows.orderBy("i").select(scale.value_bucket(F.col("v"))).collect()]
    assert buckets == sorted(buckets) and len(set(buckets)) > 12


@pytest.mark.parametrize("keys", [[], ["grp"]])
def test_buckets_against_a_plain_window(scored, keys):
    counts = M.score_counts(scored, keys, "label")
    got = M.score_path(scored, keys, "label").select(*keys, "score", "tp", "fp")
    whole = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(F.col("score").desc())
    want = counts.select(*keys, "score", F.sum("pos").over(whole).alias("tp"), F.sum("neg").over(whole).alias("fp"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_quantiles(scored):
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    row = scale.exact_quantiles(scored, [], "score", probabilities).first()
    values = [s for r in groups_of(scored).values() for _, s in r if s != -1.0]
    assert list(row) == pytest.approx(list(np.quantile(values, probabilities)))


def test_average_ranks(scored):
    got = {r["score"]: r["rank"] for r in scale.average_ranks(scored, "score").collect()}
    values = sorted(s for r in groups_of(scored).values() for _, s in r if s != -1.0)
    for v in set(values):
        assert got[v] == statistics.mean(i + 1 for i, x in enumerate(values) if x == v)


def test_auc_of_reversed_score(scored):
    both = M.roc_auc(scored.na.drop(), ["grp"], "label").join(
        M.roc_auc(scored.na.drop().withColumn("score", -F.col("score")), ["grp"], "label").withColumnRenamed("auc", "back"), "grp"
    )
    for r in both.where("auc is not null").collect():
        assert r["auc"] + r["back"] == pytest.approx(1.0)


def digest(key):
    return hashlib.md5(f"42:{key}".encode()).hexdigest()


@pytest.mark.parametrize("prefix", [1, 3])
@pytest.mark.parametrize("cap", [0, 1, 7, 100, 5000])
def test_capped_sample_is_first_by_hash(scored, prefix, cap):
    got = {(r["grp"], r["id"]) for r in Sa.sample_cap(scored, cap, ["grp"], ["id"], prefix=prefix).collect()}
    want = set()
    for group in ("hot", "one_class", "ties"):
        ids = [r["id"] for r in scored.where(F.col("grp") == group).select("id").collect()]
        want |= {(group, i) for i in sorted(ids, key=digest)[:cap]}
    assert got == want


def test_null_group_is_a_group(spark):
    df = spark.createDataFrame([(i, None if i < 5 else "a") for i in range(20)], "id long, grp string")
    counts = {r["grp"]: r["count"] for r in Sa.sample_cap(df, 3, ["grp"], ["id"]).groupBy("grp").count().collect()}
    assert counts == {None: 3, "a": 3}


def test_ranges_of_a_year_of_seconds_are_even(spark):
    start = 1_640_995_200
    df = spark.range(20_000).select((F.lit(start) + F.col("id") * 1577).alias("v"), F.lit(1).alias("n"))
    df = df.unionByName(spark.createDataFrame([(None, 1)], "v long, n int"))
    sizes = [r["count"] for r in scale._with_range(df, F.col("v").cast("double"), "b").groupBy("b").count().collect()]
    assert len(sizes) >= scale.LEAST_RANGES and max(sizes) < 2 * 20_000 / scale.LEAST_RANGES


def test_ranges_rise_with_values(spark):
    values = [None, float("-inf"), -1e300, -3.5, -0.0, 0.0, 5e-324, 0.3, 0.5, 0.5, 7.0, 1e300, float("inf"), float("nan")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r["b"] for r in scale._with_range(df, F.col("v"), "b").orderBy("i").collect()]
    assert got == sorted(got) and len(set(got)) > 8
    assert scale._with_range(df.limit(0), F.col("v"), "b").count() == 0
    assert [r["b"] for r in scale._with_range(df.where("v IS NULL"), F.col("v"), "b").collect()] == [-1]
