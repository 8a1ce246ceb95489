"""Rules on nulls, ties and empty inputs, on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from editlens import schema as S
from editlens.functions.text import decode_counts, decode_pairs, decode_strings, encode_strings, split_lines, split_sentences
from editlens.operators import aggregates as A
from editlens.operators import fairness, joins, metrics as M, revisions as R, sampling as Sa, slices as Sl

HISTORY = """wiki_db string, revision_id long, revision_is_identity_reverted boolean,
revision_first_identity_reverting_revision_id long, event_user_groups array<string>, event_user_is_bot_by array<string>,
revision_parent_id long, event_user_is_anonymous boolean, revision_tags array<string>"""


@pytest.fixture(scope="module")
def history(spark):
    return spark.createDataFrame([
        ("a", 1, True, 2, None, None, 5, True, ["mobile edit"]),
        ("a", 2, True, 3, ["sysop"], [], 5, False, []),
        ("a", 3, False, None, ["x", None], ["name"], 5, False, None),
        ("a", 4, True, 99, [], None, 0, None, ["visualeditor", "mobile edit"]),
        ("b", 1, False, None, None, None, 7, True, None),
        ("b", 2, True, 3, None, None, 7, True, None),
    ], HISTORY)


def test_reverter_is_found_within_its_wiki(history):
    rows = {(r["wiki_db"], r["revision_id"]): r for r in R.join_reverting_revision(history).collect()}
    assert len(rows) == 6
    assert rows["a", 1][S.REVERTER_REVERTED] is True and rows["a", 1][S.REVERTER_GROUPS] == ["sysop"]
    assert rows["a", 2][S.REVERTER_REVERTED] is False
    for key in (("a", 3), ("a", 4), ("b", 1), ("b", 2)):
        assert rows[key][S.REVERTER_REVERTED] is None


def test_revert_lookup_can_be_narrowed_to_a_window(history):
    window = history.where("revision_id <> 2 or wiki_db = 'b'")
    rows = {(r["wiki_db"], r["revision_id"]): r for r in R.join_reverting_revision(window, window).collect()}
    assert rows["a", 1][S.REVERTER_REVERTED] is None
    full = {(r["wiki_db"], r["revision_id"]): r for r in R.join_reverting_revision(window, history).collect()}
    assert full["a", 1][S.REVERTER_REVERTED] is True


def test_filters_keep_nulls(history):
    joined = R.join_reverting_revision(history)
    assert R.filter_revert_wars(joined).count() == 5
    assert {r["revision_id"] for r in R.filter_bots(history.where("wiki_db = 'a'")).collect()} == {1, 2, 4}
    assert R.filter_new_pages(history).count() == 5
    assert R.filter_anonymous(history).count() == 3


def test_flags(history):
    tags = {(r["wiki_db"], r["revision_id"]): r for r in R.flag_tags(history).collect()}
    assert tags["a", 4]["is_mobile_edit"] == 1 and tags["a", 4]["is_visualeditor"] == 1
    assert tags["a", 3]["is_mobile_edit"] == 0 and tags["a", 2]["is_ios_app_edit"] == 0
    trusted = R.flag_trusted_reverter(R.join_reverting_revision(history))
    assert {r["revision_id"] for r in trusted.where("is_reverted_by_good_user = 1").collect()} == {1}
    groups = {(r["wiki_db"], r["revision_id"]): r for r in R.flag_user_groups(history).collect()}
    assert groups["a", 2]["is_sysop"] is True and groups["a", 3]["is_sysop"] is False and groups["a", 1]["is_editor"] is False


def test_funnel_equals_filters(history):
    joined = R.join_reverting_revision(history)
    steps = {r["step"]: r["row_count"] for r in R.filter_funnel(joined).collect()}
    rows = R.filter_revert_wars(joined)
    assert steps == {
        "history": 6, "no_revert_wars": rows.count(), "no_bots": R.filter_bots(rows).count(),
        "no_new_pages": R.filter_new_pages(R.filter_bots(rows)).count(),
    }


def test_placeholders_and_nulls_are_dropped(spark):
    df = spark.createDataFrame([("N/A",), ("na",), (None,), ("None",), ("text",), ("n a",)], "s string")
    assert {r["s"] for r in R.filter_placeholder_text(df, ["s"]).collect()} == {"text", "n a"}


def test_missing_features(spark):
    df = spark.createDataFrame([(None, None, None), ("x", True, 2.5)], "`a b` string, f boolean, v double")
    rows = R.fill_missing_features(df, ["a b", "f", "v"]).collect()
    assert [tuple(r) for r in rows] == [("-1", -1, -1.0), ("x", 1, 2.5)]


def test_texts_need_both_sides(spark):
    revs = spark.createDataFrame([("a", 2, 1), ("a", 3, 9), ("b", 2, 1), ("a", 5, 2)], "wiki_db string, revision_id long, revision_parent_id long")
    texts = spark.createDataFrame(
        [("a", 1, "one"), ("a", 2, "two"), ("a", 3, "three"), ("b", 2, "zwei"), ("a", 5, None)],
        "wiki_db string, revision_id long, revision_text string",
    )
    rows = [tuple(r) for r in joins.join_revision_texts(revs, texts).select("wiki_db", "revision_id", "revision_text", "parent_text").collect()]
    assert rows == [("a", 2, "two", "one")]


def test_narrowest_block_wins(spark):
    blocks = spark.createDataFrame([(0, 10_000, "wide"), (500, 600, "narrow"), (70_000, 70_000, "one")], "ip_start long, ip_end long, c string")
    probes = spark.createDataFrame([(1, 550), (2, 700), (3, 70_000), (4, 60_000), (5, None), (6, 550)], "id long, ip long")
    rows = {r["id"]: r["c"] for r in joins.join_ip_range(probes, blocks, "ip", ["c"]).collect()}
    assert rows == {1: "narrow", 2: "wide", 3: "one", 4: None, 5: None, 6: "narrow"}


def test_dedup_keeps_the_first_whole(spark):
    df = spark.createDataFrame([("a", 1, "x", 2), ("a", 1, None, 1), ("b", 1, "z", 3)], "wiki_db string, revision_id long, v string, o int")
    assert sorted(tuple(r) for r in A.dedup_keys(df, S.KEYS, ["o"]).collect()) == [("a", 1, None, 1), ("b", 1, "z", 3)]


def test_scores_missing_and_last_wins(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "wiki_db string, revision_id long")
    scores = spark.createDataFrame([("a", 1, 0.9, 1), ("a", 1, 0.2, 2), ("b", 2, 0.7, 1)], "wiki_db string, revision_id long, predict_score double, o int")
    rows = {r["revision_id"]: r["m"] for r in joins.lookup_scores(df, scores, "m", order="o").collect()}
    assert rows == {1: 0.2, 2: -1.0}


def test_more_positives_than_negatives(spark):
    df = spark.createDataFrame([("a", i, i < 8, True) for i in range(10)] + [("a", 10, None, True)], f"wiki_db string, revision_id long, {S.LABEL} boolean, is_anonymous boolean")
    flagged = Sa.balance_flag(df)
    assert flagged.count() == 11 and flagged.where("is_balanced = 1").count() == 10
    assert flagged.where("revision_id = 10").first()["is_balanced"] == 0
    assert Sa.balance_two_sided(df).count() == 4


def test_title_sides_are_disjoint(spark):
    df = spark.createDataFrame([("a" if i % 2 else "b", i, f"t{i % 11}") for i in range(300)], "wiki_db string, revision_id long, page_title string")
    rows = Sa.split_by_title(df)
    assert rows.groupBy("wiki_db", "page_title").agg(F.countDistinct("is_text_train").alias("n")).where("n > 1").count() == 0
    titles = rows.where("is_text_train = 1").select("wiki_db", "page_title").distinct().groupBy("wiki_db").count().collect()
    assert {r["count"] for r in titles} == {6}


def test_empty_frames(spark):
    df = spark.createDataFrame([], f"wiki_db string, revision_id long, {S.LABEL} boolean, is_anonymous boolean, score double")
    assert M.metric_table(df, [S.WIKI]).count() == 0
    assert Sa.balance_per_language(df).count() == 0
    assert Sa.split_random(df).count() == 0


def test_threshold_is_strict_and_missing_is_negative(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.6), (0, None), (0, -1.0), (1, None)], f"{S.LABEL} int, score double")
    row = M.binary_metrics(df, []).first()
    assert (row["true_pos"], row["false_neg"], row["true_neg"], row["false_pos"]) == (1, 2, 2, 0)


def test_nothing_predicted(spark):
    df = spark.createDataFrame([(1, 0.1), (0, 0.1)], f"{S.LABEL} int, score double")
    row = M.metric_table(df, []).first()
    assert (row["precision"], row["recall"], row["f1"], row["auc"]) == (0.0, 0.0, 0.0, 0.5)


def test_recall_limit_is_strict(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (1, 0.7), (1, 0.2), (0, 0.5)], f"{S.LABEL} int, score double")
    assert M.precision_at_recall(df, [], level=0.75).first()[0] == pytest.approx(0.8)


def test_agreement_means_all_equal(spark):
    # Two models wrong and one right is no agreement, although (a == b) == c would say so.
    df = spark.createDataFrame([(1, 0.1, 0.1, 0.9), (1, 0.9, 0.9, 0.9), (0, 0.9, 0.9, 0.9)], f"{S.LABEL} int, a double, b double, c double")
    row = M.agreement_rates(df, ["a", "b", "c"]).first()
    assert (row["all_same"], row["all_correct"], row["any_correct"]) == pytest.approx((2 / 3, 1 / 3, 2 / 3))


def test_tied_quantiles_share_a_bucket(spark):
    df = spark.createDataFrame([(v,) for v in [1] * 30 + list(range(2, 8)) + [None]], "v int")
    rows = Sl.quantile_buckets(df, "v", "b").groupBy("v").agg(F.collect_set("b").alias("b")).collect()
    buckets = {r["v"]: r["b"] for r in rows}
    assert buckets[1] == [12] and buckets[None] == [] and buckets[7] == [1]


def test_equal_groups_are_fair(spark):
    rows = [("m", flag, y, s) for flag in (True, False) for y, s in [(1, 0.9), (0, 0.2), (1, 0.4), (0, 0.8)]]
    df = spark.createDataFrame(rows, f"model string, is_anonymous boolean, {S.LABEL} int, score double")
    row = fairness.fairness_table(df).first()
    assert (row["disparate_impact_base"], row["disparate_impact"], row["auc_difference"]) == (1.0, 1.0, 0.0)
    gaps = fairness.group_gap_metrics(df).first()
    assert list(gaps)[1:] == [0.0, 0.0, 0.0, 0.0]


def test_sentences_and_lines(spark):
    df = spark.createDataFrame([("One. Two!  Three?",), ("a.b",), ("",), ("...",), ("x\ny.\n",)], "t string")
    rows = [r[0] for r in df.select(split_sentences("t")).collect()]
    assert rows[:4] == [["One", "Two", "Three?"], ["a", "b"], [""], ["", "", "."]]
    lines = spark.createDataFrame([("a\r\nb\rc\n",), ("",), ("a\n\nb",), ("a b\x0cc",)], "t string")
    assert [r[0] for r in lines.select(split_lines(F.col("t"))).collect()] == [["a", "b", "c"], [], ["a", "", "b"], ["a", "b", "c"]]


def test_decoding_of_written_lists(spark):
    texts = ["plain", "it's", 'say "x"', "back\\slash", "two\nlines", "nb\xa0sp", "None", "ends with \\x41", ""]
    rows = [(repr(texts), repr([("a'b", "c"), ("d", 'e"f')]), repr({"insert_Text": 3})), ("[]", "[]", "{}"), ("[oops", "(1", "?"), (None, None, None)]
    df = spark.createDataFrame(rows, "t string, p string, a string")
    got = df.select(decode_strings(F.col("t")).alias("t"), decode_pairs(F.col("p")).alias("p"), decode_counts(F.col("a")).alias("a")).collect()
    assert got[0]["t"] == texts and [tuple(x) for x in got[0]["p"]] == [("a'b", "c"), ("d", 'e"f')] and got[0]["a"] == {"insert_Text": 3}
    assert got[1]["t"] == [] and got[1]["p"] == [] and got[1]["a"] == {}
    assert got[2]["t"] is None and got[2]["p"] is None and got[2]["a"] is None
    assert got[3]["t"] is None
    back = spark.createDataFrame([(texts,)], "t array<string>").select(decode_strings(encode_strings(F.col("t")))).first()[0]
    assert back == texts


def test_exchange_file_is_matched_by_header(spark, tmp_path):
    from editlens.functions.text import decode_counts, decode_pairs, decode_strings
    from editlens.sources import files

    (tmp_path / "a.csv").write_text(
        "revision_id,texts_insert,wiki_db,texts_change,actions,revision_is_identity_reverted,more\n"
        "7.0,\"['finance', 'a, b']\",enwiki,\"[('x', 'y')]\",\"{'insert_Word': 2}\",1,z\n"
        "8,\"('banana', 'b')\",dewiki,,,bad,z\n9,\"['a']['b']\",frwiki,[],{},0,z\n"
    )
    rows = files.read_csv_dataset(spark, str(tmp_path / "a.csv"))
    assert rows.columns == [f.name for f in S.REVISION_CSV] and rows.where("event_comment IS NOT NULL").count() == 0
    got = rows.orderBy("revision_id").select(
        "revision_id", "wiki_db", "revision_is_identity_reverted", decode_strings(F.col("texts_insert")).alias("t"),
        decode_pairs(F.col("texts_change")).alias("p"), decode_counts(F.col("actions")).alias("a"),
    ).collect()
    assert [tuple(r[:4]) for r in got] == [
        (7, "enwiki", 1, ["finance", "a, b"]), (8, "dewiki", None, ["banana", "b"]), (9, "frwiki", 0, None)
    ]
    assert [tuple(p) for p in got[0].p] == [("x", "y")] and got[0].a == {"insert_Word": 2} and got[2].p == []


def test_categories_beyond_the_default_bins(spark):
    from editlens.models import classifier as C

    rows = spark.range(1500).select(
        F.col("id").alias("revision_id"), F.lit("enwiki").alias("wiki_db"), F.concat(F.lit("c"), F.col("id") % 240).alias("country"),
        F.col("id").cast("double").alias("x"), (F.col("id") % 3 == 0).cast("int").alias(S.LABEL),
    )
    model, scored = C.train_and_test(rows, ["country", "x"], ["country"], settings=C.TrainingSettings(rounds=1, depth=2))
    assert 0 < scored.count() < 400 and model.stages[-1].getMaxBins() > 240


def test_scorer_with_one_output(spark):
    import pandas as pd

    from editlens.operators import fragments as Fr

    texts = spark.createDataFrame([("a", None), ("bb", "c")], "text string, text_pair string")
    scored = Fr.score_fragments(texts, lambda f: pd.DataFrame({"s_0": f["text"].str.len() / 2}))
    assert {tuple(r) for r in scored.select("text", "s_0", "s_1").collect()} == {("a", 0.5, None), ("bb", 1.0, None)}
