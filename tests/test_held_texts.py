"""What tasks hold of texts: Python a piece of a batch, the JVM a small part of the elements."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from editlens.functions import similarity
from editlens.operators import diff, elements, markup


@pytest.fixture()
def lists(spark):
    rng = random.Random(5)
    sentence = lambda: " ".join(rng.choice(["river", "town", "old", "bridge", "mill"]) for _ in range(8))
    rows = [(i, [sentence() for _ in range(6)], [sentence() for _ in range(6)]) for i in range(30)]
    rows = [(i, sorted(set(o)), sorted(set(n) - set(o))) for i, o, n in rows] + [(30, None, ["a"]), (31, [], ["a"])]
    return spark.createDataFrame(rows, "id long, deleted array<string>, added array<string>")


def test_pairs_are_handed_on_in_pieces(lists, monkeypatch):
    monkeypatch.setattr(diff, "CHARS", 100, raising=False)
    got = {r["id"]: [p.asDict() for p in r["m"]] for r in lists.select("id", diff.match_changed_sentences(F.col("deleted"), F.col("added")).alias("m")).collect()}
    want = {r["id"]: diff.match_sentences(r["deleted"], r["added"], 60) if r["deleted"] else [] for r in lists.collect()}
    assert got == want and any(want.values())


def test_a_filter_on_pairs_matches_once(lists):
    matched = diff.match_sentence_sets(lists).select("id", F.inline("texts_change"))
    assert matched._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_elements_are_handed_on_in_pieces(monkeypatch):
    monkeypatch.setattr(markup, "CHARS", 50, raising=False)
    texts = ["{{a|b}} [[c]]", None, "", "plain", "<ref>x</ref>" * 20] * 5
    pieces = list(markup._bracketed.func(iter([pa.array(texts)])))
    found = [[(e["type"], e["value"]) for e in row] for piece in pieces for row in piece.to_pylist()]
    assert len(pieces) > 5 and found == [markup.bracketed(t) if t else [] for t in texts]


def test_matrices_of_long_texts_are_bounded(monkeypatch):
    rng, sizes = random.Random(2), []
    first, second = ([" ".join(rng.choices(["ab", "ba", "cd"], k=20)) for _ in range(60)] for _ in range(2))
    want = [x.tolist() for x in similarity.similar_pairs(first, second, 60)]
    padded = similarity._padded
    monkeypatch.setattr(similarity, "_padded", lambda *a: sizes.append((out := padded(*a)).size) or out)
    monkeypatch.setattr(similarity, "CELLS", 1 << 14)
    monkeypatch.setattr(similarity, "FEW", 0)
    got = [x.tolist() for x in similarity.similar_pairs(first, second, 60)]
    assert sorted(zip(*got)) == sorted(zip(*want)) and max(sizes) <= 1 << 14


def test_texts_are_taken_apart_by_many_tasks(spark):
    rows = spark.range(50).select(F.col("id").alias("revision_id"), F.concat("id", F.lit("wiki")).alias("wiki_db"), F.lit("one two. three").alias("parent_text"), F.concat(F.lit("two one. "), "id").alias("revision_text"))
    counts = elements.edit_action_counts(rows)
    assert counts.count() == 50
    assert counts.rdd.getNumPartitions() >= 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
