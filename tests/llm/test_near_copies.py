"""The chosen-path join against all pairs, and the pipeline."""

import random
from collections import Counter

import pytest
from made_up import prose

import corpus_pipeline
from editlens.llm import chosen_path


def set_of(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def groups_by_hand(rows):
    """Smallest id of each row's group, by comparing all pairs."""
    sets = [set_of(t) for _, t in rows]
    of = list(range(len(rows)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                of[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return Counter((doc, len(sets[i]), least.get(root(i))) for i, (doc, _) in enumerate(rows))


def check(docs):
    got = chosen_path.near_duplicates(docs).collect()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == groups_by_hand(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_awkward_rows(awkward):
    check(awkward)


def test_nothing(empty):
    assert chosen_path.near_duplicates(empty).count() == 0


def copies(seed, base, n, most):
    """Copies with up to so many changed words, which is more than a link allows for some of them."""
    rng = random.Random(seed)
    for _ in range(n):
        words = base.split(" ")
        for _ in range(rng.randint(0, most)):
            words[rng.randrange(len(words))] = f"w{rng.random()}"
        yield " ".join(words)


@pytest.mark.parametrize("small", [2048, 40])
def test_families_of_near_copies(spark, monkeypatch, small):
    monkeypatch.setattr(chosen_path, "SMALL", small)
    texts = [prose(100 + i, 60) for i in range(60)]
    for k in range(6):
        texts += copies(k, prose(k, 150), 40, 12)
    texts += copies(9, prose(50, 90), 200, 5)
    passage = prose(77, 70)
    texts += [prose(200 + i, 100) + " " + passage + " " + prose(300 + i, 100) for i in range(60)]
    rng = random.Random(1)
    rng.shuffle(texts)
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))


def test_one_of_each_group_stays(awkward):
    kept = chosen_path.without_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    rows = kept.select("doc_id", "text").collect()
    ids = Counter(r.doc_id for r in rows)
    assert ids[0] == 1 and not {1, 2, 3, 8, 10} & set(ids) and ids[16] == 1 and ids[None] == 2 and {4, 5, 6, 7, 9, 11} <= set(ids)


def test_stage_links_from_four_fifths_on(spark):
    """Pairs between 0.80 and 0.85 are one document for the stage and two for the query; below 0.80 they are two."""
    rows, alike = [], []
    for i in range(30):
        words = prose(500 + i, 150).split(" ")
        other = list(words)
        for k in range(3 if i % 2 else 5):
            other[20 + 25 * k] = "changed"
        a, b = set_of(" ".join(words)), set_of(" ".join(other))
        alike.append(len(a & b) / len(a | b))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    assert all(0.8 <= s < 0.85 if i % 2 else s < 0.8 for i, s in enumerate(alike))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == set(range(60)) - {2 * i + 1 for i in range(1, 30, 2)}
    assert chosen_path.near_duplicates(docs).where("kept").count() == 60
    assert (chosen_path.least_equal(85), chosen_path.trees(85)) == (188, 5) and (chosen_path.least_equal(80), chosen_path.trees(80)) == (173, 8)


def test_stages_keep_columns(spark, awkward, tmp_path):
    folder = str(tmp_path)
    awkward.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (9, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = awkward
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.schema.names == awkward.schema.names, name
        docs = spark.createDataFrame(docs.collect(), awkward.schema)
    kept = {r.doc_id for r in docs.collect()}
    assert not kept & {1, 2, 3, 4, 5, 6, 7, 8, 10, 15}
    out = corpus_pipeline.run(spark, folder)
    assert Counter(r.doc_id for r in out.collect()).keys() <= {r.doc_id for r in awkward.collect()}


def test_stages_on_nothing(spark, empty, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0
