"""The past of users and pages against plain Python, and counts of texts."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from editlens import schema as S
from editlens.operators import edit_features as EF

SCHEMA = "wiki_db string, revision_id long, u string, t timestamp"


def brute(rows):
    out = {}
    for wiki, rid, user, time in rows:
        if None in (wiki, user, time):
            out[wiki, rid] = (None, None, None)
            continue
        mine = sorted((t, i) for w, i, u, t in rows if (w, u) == (wiki, user) and t is not None and (t, i) <= (time, rid))
        since = None if len(mine) == 1 else int((time - mine[-2][0]).total_seconds())
        out[wiki, rid] = (len(mine), int((time - mine[0][0]).total_seconds()), since)
    return out


def test_past(spark):
    rng = random.Random(1)
    start = datetime(2022, 1, 1, tzinfo=timezone.utc)
    rows = []
    for i in range(600):
        user = rng.choice(["bot"] * 6 + ["a", "b", "c", None, ""])  # one user has most edits
        time = None if rng.random() < 0.03 else start + timedelta(seconds=rng.choice([rng.randrange(40 * 86_400), 86_400 * 3, 86_400 * 3 - 1]))
        rows.append((rng.choice(["x", "y", None]) if rng.random() < 0.2 else "x", i, user, time))
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {(r.wiki_db, r.revision_id): (r.p_n, r.p_age, r.p_since) for r in EF.with_past(df, [S.WIKI, "u"], "t", S.ID, "p").collect()}
    assert got == brute(rows)


def test_a_busy_user_is_split_by_day(spark):
    df = spark.range(60_000).select(
        F.lit("x").alias("wiki_db"), F.col("id").alias("revision_id"), F.lit("bot").alias("u"),
        F.timestamp_seconds(F.lit(1_640_995_200) + F.col("id") * 60).alias("t"),
    )
    past = EF.with_past(df, [S.WIKI, "u"], "t", S.ID, "p")
    assert past.where("p_n <> revision_id + 1 OR p_age <> revision_id * 60 OR coalesce(p_since, 60) <> 60").count() == 0
    plan = past._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():  # every window over rows is per day; the one over a whole history sees days
        if "Window [row_number" in line or "Window [lag" in line:
            assert "__day" in line.split("windowspecdefinition(")[1]


def test_no_rows(spark):
    assert EF.with_past(spark.createDataFrame([], SCHEMA), [S.WIKI, "u"], "t", S.ID, "p").count() == 0


def test_content_counts(spark):
    text = "== A ==\n=== B ===\n[[x]] [[File:y]] [[Datei:z]] [[Category:c]] <ref>q [[w]]</ref><ref name=a/> é"
    texts = spark.createDataFrame([("dewiki", 1, text), ("enwiki", 2, ""), ("enwiki", 3, None)], "wiki_db string, revision_id long, revision_text string")
    aliases = spark.createDataFrame([("de", "Datei", "Media")], "lang string, alias string, type string")
    rows = {r.revision_id: r for r in EF.content_counts(texts, aliases=aliases).collect()}
    one = rows[1]
    assert set(rows) == {1, 2} and rows[2].quality_score == 0.0 and rows[2].revision_text_bytes == 0
    assert (one.reference_count, one.wikilink_count, one.category_count, one.media_count, one.heading_count) == (2, 2, 1, 2, 2)
    assert one.revision_text_bytes == one.text_length + 1
    assert abs(one.quality_score - (len(text) / 10_000 + 2 / 10 + 2 / 20 + 1 / 5 + 2 / 3 + 2 / 5) / 6) < 1e-12


def test_features_of_missing_sources(spark):
    history = spark.createDataFrame(
        [("x", 1, 0, None, None, None, None, None, None, None), ("x", 2, 1, "P", datetime(2022, 1, 1), "u", 5, ["a", "b"], True, "c"),
         ("x", 3, 99, "P", datetime(2022, 1, 2), "u", None, [], False, None)],
        "wiki_db string, revision_id long, revision_parent_id long, page_title string, event_timestamp timestamp, event_user_text_historical string, "
        "revision_text_bytes_diff long, event_user_groups array<string>, event_user_is_anonymous boolean, event_comment string")
    texts = spark.createDataFrame([("x", 1, "short"), ("x", 2, "== H ==\n" + "t" * 20_000)], "wiki_db string, revision_id long, revision_text string")
    rows = {r.revision_id: r for r in EF.edit_features(history, EF.content_counts(texts)).collect()}
    assert list(rows[1].asDict())[2:] == S.EXTRA_FEATURES
    assert rows[1].user_age is None and rows[1].page_age is None and rows[1].parent_text_length is None and rows[1].text_length == 5
    assert rows[2].parent_text_length == 5 and rows[2].quality_change > 0 and rows[2].user_groups == "a,b" and rows[2].has_comment
    assert rows[3].text_length is None and rows[3].quality_change is None and rows[3].user_revision_count == 2 and rows[3].user_groups == ""
    assert rows[3].page_seconds_since_previous_revision == 86_400 == rows[3].page_age
