"""Index intervals against plain counting, and the whole query against its SQL and against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from compare import connect, differences
from editlens.llm import collocations, queries


@given(st.lists(st.integers(0, 4), max_size=60), st.sampled_from([2, 3]))
@settings(max_examples=300, deadline=None)
def test_intervals(symbols, depth):
    sequence = np.array([0, *symbols, 0], np.int32)
    text = sequence.tolist()
    index = collocations.ShardIndex(sequence, depth)
    words = np.arange(1, int(sequence.max()) + 1)
    level = [((w,), f, b, n) for w, f, b, n in zip(words.tolist(), *map(np.ndarray.tolist, index.words(words)), strict=True)]
    for k in range(2, depth + 1):
        for side in ("left", "right"):
            level.sort(key=lambda x: x[1 if side == "left" else 2])
            arrays = [np.array([x[i] for x in level], np.int64) for i in (1, 2, 3)]
            parent, word, f, b, n = map(np.ndarray.tolist, getattr(index, side)(*arrays))
            new = [((w, *level[p][0]) if side == "left" else (*level[p][0], w), x, y, z)
                   for p, w, x, y, z in zip(parent, word, f, b, n, strict=True)]
            want = Counter(g for i in range(len(text) - k + 1) if 0 not in (g := tuple(text[i:i + k])))
            assert {g: size for g, _, _, size in new} == dict(want)
        level = new


def test_wide_alphabet():
    rng = np.random.default_rng(5)
    sequence = np.append(rng.integers(0, 3_000_000, 5000), [7, 8, 9, 7, 8, 9, 0]).astype(np.int32)
    index = collocations.FMIndex(sequence, int(sequence.max()) + 1, 3)
    low = index.first[[9]]
    parent, symbol, _, size = index.extend(low, index.first[[10]] - low)
    assert (8, 2) in zip(symbol.tolist(), size.tolist(), strict=True)


def plain(rows, least, top, percent=50):
    one, two, three, n = Counter(), Counter(), Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            one.update((lang, x) for x in w)
            two.update((lang, *x) for x in zip(w, w[1:], strict=False))
            three.update((lang, *x) for x in zip(w, w[1:], w[2:], strict=False))
    big = {k: a for k, a in (two + three).items() if a >= least}
    out = []
    for key, a in big.items():
        lang, words = key[0], key[1:]
        if len(words) == 2 and any(
            100 * b >= percent * a for k, b in big.items() if k[0] == lang and len(k) == 4 and words in (k[1:3], k[2:4])
        ):
            continue
        f = lambda p: (one if len(p) == 1 else two)[(lang, *p)]
        score, cut = min((1_000_000 * a * a // (f(words[:k]) * f(words[k:])), k) for k in range(1, len(words)))
        out.append((lang, " ".join(words), a, f(words[:cut]), f(words[cut:]), n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranks, ranked = Counter(), []
    for r in out:
        ranks[r[0]] += 1
        if ranks[r[0]] <= top:
            ranked.append((r[0], ranks[r[0]], *r[1:]))
    return ranked


def got(frame):
    return sorted(tuple(r) for r in frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("shard_words", [40, 500, 2_000_000])
def test_against_plain_counts(spark, shard_words):
    rng = random.Random(2)
    words = ["a", "B", "ccc", "d", "éé", "日本", "x y"]
    marks = [" ", "  ", "\t", " ", " ", ". ", ",", "\n", "\r\n", "!?", "\x0b"]
    rows = [(rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randint(0, 60)))) for _ in range(60)]
    rows += [("en", None), (None, ""), ("fr", " \t.\n"), ("en", "a b a b a b a b " * 50), ("de", "zz zz zz " * 9)]
    frame = spark.createDataFrame([(t, lang, "s") for lang, t in rows], "text string, lang string, score string").repartition(5)
    assert got(collocations.collocations(frame, least=4, top=12, shard_words=shard_words)) == sorted(plain(rows, 4, 12))


def test_awkward_documents(awkward, empty):
    rows = [(r.lang, r.text) for r in awkward.collect()]
    assert got(collocations.collocations(awkward, least=2, shard_words=10_000)) == sorted(plain(rows, 2, 2000))
    assert got(collocations.collocations(empty)) == []


def test_query_and_sql(spark):
    folder = "/root/testdata/sf0.01"
    sql = queries.ORACLES["op13_phrase_collocations"]
    assert differences(queries.op13_phrase_collocations(spark, folder), connect(folder), sql) is None


def test_score_beyond_64_bits(spark):
    big = F.lit(4_000_000_000_000_000)
    frame = spark.range(1).select(collocations._score(big, big, big + 1).alias("s"))
    assert frame.first().s == 1_000_000 * 4_000_000_000_000_000 // 4_000_000_000_000_001
