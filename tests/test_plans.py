"""Shapes of physical plans: how often data moves, and that no join compares everything with everything."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from editlens import schema as S
from editlens.checks.fixtures import Tables
from editlens.operators import diff, elements, joins
from editlens.plans import collection
from editlens.session import work_path
from editlens.sources import files

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"(?<!Broadcast)(?<!Reused)Exchange ", plan_of(df)))


def text_exchanges(df):
    """Exchanges whose rows hold whole texts, or their lines or elements."""
    lines = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted").split("\n")
    moved = 0
    for i, line in enumerate(lines):
        if re.match(r"\(\d+\) Exchange", line):
            moved += bool(re.search(r"Input \[.*\b(?:revision_text|parent_text|__text|line|value|__old|__new|__old_found)#", lines[i + 1]))
    return moved


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, FOLDER)


def test_texts_move_once(tables):
    assert exchanges(diff.sentence_sets(diff.line_set_diff(tables.pairs), S.KEYS)) == 1
    assert exchanges(diff.diff_lines(tables.pairs)) == 0  # starts from the written sentences
    assert exchanges(elements.edit_action_counts(tables.pairs)) == 1


def test_bucketed_texts_stay_in_place(spark, tables):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        files.write_bucketed(tables.wikitext, "bucketed_texts", work_path(spark, "texts"), 8)
        revisions = tables.pairs.select((F.col(S.ID) * 2).alias(S.ID), S.WIKI).withColumn(S.PARENT, F.col(S.ID) - 1)
        plain = joins.join_revision_texts(revisions, tables.wikitext)
        bucketed = joins.join_revision_texts(revisions, spark.table("bucketed_texts"))
        assert exchanges(bucketed) == exchanges(plain) - 2 == 2  # revisions to their parents' bucket, parents' texts back
        assert text_exchanges(bucketed) == 1
        assert plain.exceptAll(bucketed).count() == 0 and bucketed.count() == plain.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("DROP TABLE IF EXISTS bucketed_texts")


@pytest.mark.parametrize("bucketed", [True, False])
def test_collection_moves_texts_once(spark, tables, monkeypatch, bucketed):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    written = []
    for module in (collection, joins, diff):
        for name in ("materialize", "materialize_bucketed"):
            if hasattr(module, name):
                monkeypatch.setattr(module, name, lambda df, *rest, f=getattr(module, name): written.append(df) or f(df, *rest))
    docs = tables.table("documents").select((F.col("doc_id") + 1).alias(S.ID), F.lit("enwiki").alias(S.WIKI), F.col("text").alias("revision_text"))
    wikitext = docs.select("*", F.lit("2022-11").alias("snapshot"), F.lit(0).alias("page_namespace"))
    revisions = docs.select(S.WIKI, S.ID, (F.col(S.ID) - 1).alias(S.PARENT))
    try:
        settings = collection.CollectionSettings()
        if bucketed:
            files.write_bucketed(wikitext, "bucketed_wikitext", work_path(spark, "texts"), 8)
            wikitext, settings = spark.table("bucketed_wikitext"), collection.CollectionSettings(text_buckets=8)
        result = collection.text_differences(revisions, wikitext, settings)
        moved = [text_exchanges(df) for df in [*written, result]]
        # Bucketed texts: the parents' texts. Others: the wanted texts once more, into buckets.
        assert sum(moved) == (1 if bucketed else 2)
        assert result.count() == revisions.count() - 1
        assert result.where(F.size("actions") > 0).count() > 0 and result.where(F.size("texts_insert") > 0).count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("DROP TABLE IF EXISTS bucketed_wikitext")


LIGHT = [
    "revert_overview_by_wiki", "join_reverting_revision", "join_revision_texts", "join_ip_range", "insert_features",
    "balance_per_language", "split_random", "roc_auc", "fairness_table", "quantile_buckets", "metrics_by_quantile",
    "rank_correlation", "semi_join_topk", "model_leaderboard", "class_weights",
]


@pytest.mark.parametrize("name", LIGHT)
def test_no_join_of_everything_with_everything(spark, name):
    plan = plan_of(entry_point.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(entry_point.queries()["scan_history"](spark, FOLDER))
    assert "GreaterThanOrEqual(ts" in plan
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "value" not in schema and "user_id" not in schema
