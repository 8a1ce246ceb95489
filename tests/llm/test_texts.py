"""Separator scan, compression bands, cross entropy, toxicity and BPE against plain Python."""

import base64
import hashlib
import zlib
from collections import Counter
from math import log

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import zstandard
from made_up import prose
from pyspark.sql import functions as F

from editlens.llm import bpe, compression, cross_entropy, token_files, toxicity


def reference_encoding(name):
    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# --- BPE


def test_bpe_round_trip(awkward):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    got = bpe.digests(awkward, ["doc_id", "score"], path, public_tokenizers.PATTERN, batch_chars=1000).collect()
    enc = reference_encoding("byte_bpe_multi_50k.tiktoken")
    want = []
    for r in awkward.collect():
        ids = enc.encode_ordinary(r.text or "")
        want.append((r.doc_id, r.score, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert Counter(map(tuple, got)) == Counter(want)


def test_bpe_of_nothing(empty):
    assert bpe.digests(empty, ["doc_id"], public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def test_pair_table_finds_every_pair():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257, b"bc": 258}
    table = bpe.PairTable(ranks)
    a, b, c = (ord(x) for x in "abc")
    got = table(np.array([a, 256, a, b, c, -1]), np.array([b, c, 258, c, a, a]))
    assert got.tolist() == [256, 257, 257, 258, bpe.NONE, bpe.NONE]


# --- separator scan


def test_token_files(spark, awkward, tmp_path):
    path = str(tmp_path / "flat")
    token_files.write_token_files(awkward, path, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    enc = reference_encoding("byte_bpe_50k.tiktoken")
    lengths = Counter(len(enc.encode_ordinary(r.text or "")) for r in awkward.collect())
    for block in (1, 7, 1000, 1 << 20):
        rows = token_files.scan_token_files(spark, path, block).collect()
        assert Counter(r.n_tokens for r in rows) == lengths and all(r.closed for r in rows)
        for name in {r.path for r in rows}:
            mine = sorted((r.doc_no, r.start, r.n_tokens) for r in rows if r.path == name)
            assert [m[0] for m in mine] == list(range(len(mine)))
            for a, b in zip(mine, mine[1:], strict=False):
                assert b[1] == a[1] + a[2] + 1


def test_open_and_empty_files(spark, tmp_path):
    folder = tmp_path / "flat"
    folder.mkdir()
    sep = token_files.SEPARATOR
    np.array([sep, sep, 1, 2, 3], "<u2").tofile(folder / "part-00000-a.txt")
    np.array([], "<u2").tofile(folder / "part-00001-b.txt")
    np.array([5] * 10, "<u2").tofile(folder / "part-00002-c.txt")
    rows = token_files.scan_token_files(spark, str(folder), 2).select(token_files.part_number().alias("f"), "doc_no", "start", "n_tokens", "closed")
    assert sorted(map(tuple, rows.collect())) == [(0, 0, 0, 0, True), (0, 1, 1, 0, True), (0, 2, 2, 3, False), (2, 0, 0, 10, False)]
    (folder / "part-00003-d.txt").write_bytes(b"abc")
    with pytest.raises(Exception, match="whole number of tokens"):
        token_files.scan_token_files(spark, str(folder), 2).count()


def test_no_documents_no_tokens(spark, empty, tmp_path):
    path = str(tmp_path / "flat")
    token_files.write_token_files(empty, path, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert token_files.scan_token_files(spark, path).count() == 0


# --- compression bands


def judge_by_hand(text):
    text = text or ""
    blanks = " \t\n\x0b\x0c\r"
    words, word = [], ""
    for c in text + " ":
        if c in blanks:
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if line.strip(blanks):
            repeats += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    raw = text.encode()
    ratio = lambda b: len(b) / len(zstandard.ZstdCompressor(level=3).compress(b))
    ok = bool(raw)
    if raw:
        upper = max(2.3, 2.15 + 0.115 * (np.log2(len(raw)) - 8))
        lower = 1.4 if len(raw) >= 4096 else 1.3 if len(raw) >= 1024 else 1.15 if len(raw) >= 512 else 1.05 if len(raw) >= 256 else 0
        ok = lower <= ratio(raw) <= upper
        if len(raw) >= 8192:
            n = len(raw) // 4096
            parts = [raw[4096 * i:4096 * (i + 1) if i < n - 1 else None] for i in range(n)]
            ok = ok and sum(not 1.3 <= ratio(p) <= 3.5 for p in parts) <= 0.25 * n
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeats, len(covered), failed, not failed and ok


def test_bands(awkward):
    got = compression.with_verdict(awkward.select("doc_id", "text", "score"), ["doc_id", "score"]).collect()
    assert Counter((r.doc_id, r.score, *r[2:9]) for r in got) == Counter((r.doc_id, r.score, *judge_by_hand(r.text)) for r in awkward.collect())


def test_bands_tell_noise_and_repetition_from_prose(spark):
    rng = np.random.default_rng(1)
    noise = base64.b85encode(rng.integers(0, 256, 20_000, dtype=np.uint8).tobytes()).decode()
    noise = " ".join(noise[i:i + 9] for i in range(0, len(noise), 9))
    nearly = " ".join(f"{w} {w} {w} {w}" for w in prose(3, 600).split())
    half = prose(9, 2500) + " ".join(["la li lu"] * 60) + prose(10, 2500)
    texts = {"prose": prose(2, 3000), "noise": noise, "repeat": nearly, "half": half}
    rows = compression.with_verdict(spark.createDataFrame(list(texts.items()), "name string, text string"), ["name"]).collect()
    assert {r.name: r.kept for r in rows} == {"prose": True, "noise": False, "repeat": False, "half": True}


def test_bands_of_nothing(empty):
    assert compression.with_verdict(empty, ["doc_id"]).count() == 0


# --- cross-entropy difference


def test_cross_entropy_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b a b", 0), (2, "a c", 0), (3, "B  a Long-word! 99", 0), (4, None, 0), (5, "", 0), (5, "a b", 0)], "doc_id long, text string, n_tokens int")
    size = cross_entropy.SHAPES + 4
    targets = spark.createDataFrame([(1,), (1,), (None,), (77,)], "doc_id long")
    model = cross_entropy.learn(docs, targets, size)
    vocabulary = model[0]
    assert list(vocabulary) == [b"a", b"b", b"99"]
    ident = lambda w: vocabulary.get(w, None) or cross_entropy._shape(w)
    texts = [[0, *map(ident, (t or "").lower().encode().split()), 0] for t in (r.text for r in docs.collect())]
    pairs = lambda t: list(zip(t, t[1:], strict=False)) if len(t) > 2 else []
    target, background = Counter(pairs(texts[0])), Counter(p for t in texts for p in pairs(t))
    scale = sum(target.values()) / sum(background.values())

    def loss(counts, pair, factor):
        total = sum(counts.values()) * factor + 0.5 * size
        single = lambda w: (sum(c for p, c in counts.items() if p[1] == w) * factor + 0.5) / total
        before = sum(c for p, c in counts.items() if p[0] == pair[0]) * factor
        return -log((counts[pair] * factor + 100 * single(pair[1])) / (before + 100))

    rows = cross_entropy.with_score(docs, ["doc_id", "text"], model, size).collect()
    assert len(rows) == 6
    for r, t in zip(rows, texts, strict=True):
        found = pairs(t)
        if not found:
            assert (r.n_tokens, r.target_loss, r.background_loss, r.score) == (0, None, None, 0.0)
            continue
        a = sum(loss(target, p, 1) for p in found) / len(found)
        b = sum(loss(background, p, scale) for p in found) / len(found)
        assert r.n_tokens == len(found) - 1 and r.target_loss == pytest.approx(a, abs=1e-5) and r.score == pytest.approx(b - a, abs=1e-5)


def test_no_target_no_difference(awkward, empty):
    model = cross_entropy.learn(awkward, empty)
    assert all(r.score == 0 for r in cross_entropy.with_score(awkward, ["doc_id"], model).collect())
    assert cross_entropy.with_score(empty, ["doc_id"], cross_entropy.learn(empty, empty)).count() == 0


def corpus_by_hand(texts, is_target):
    words = [[w for w in (t or "").encode().lower().split()] for t in texts]
    pairs = [list(zip([b"", *w], [*w, b""], strict=True)) if w else [] for w in words]
    size = len({p[1] for found in pairs for p in found})
    background = Counter(p for found in pairs for p in found)
    target = Counter(p for found, mine in zip(pairs, is_target, strict=True) if mine for p in found) or background
    scale = sum(target.values()) / sum(background.values())

    def losses(counts, factor):
        ends, starts, total = Counter(), Counter(), sum(counts.values()) * factor + 0.5 * size
        for (a, b), n in counts.items():
            starts[a] += n * factor
            ends[b] += n * factor
        return lambda p: -log((counts[p] * factor + 100 * (ends[p[1]] + 0.5) / total) / (starts[p[0]] + 100))

    one, other = losses(target, 1), losses(background, scale)
    return [(len(w), sum(map(one, p)) / len(p), sum(map(other, p)) / len(p)) if p else (0, None, None) for w, p in zip(words, pairs, strict=True)]


@pytest.mark.parametrize("bucket_tokens", [40, 2000, cross_entropy.BUCKET_TOKENS])
def test_every_word_has_counts_of_its_own(spark, bucket_tokens, monkeypatch):
    # 6,000 words that only targets use and 6,000 that only others use, all of one shape: classes cannot tell them apart
    texts = [" ".join(f"the {'ab'[i % 2]}{k:06d}" for k in range(100 * (i // 4), 100 * (i // 4) + 100)) for i in range(240)]
    texts += [None, " ", "The the THE", "日本語のテキスト"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, score int").repartition(5)
    targets = spark.createDataFrame([(i,) for i in range(0, 240, 2)] + [(None,), (2,)], "doc_id long")
    monkeypatch.setattr(cross_entropy, "CHUNK_DOCS", 17)
    rows = cross_entropy.score_corpus(docs, targets, ["doc_id", "text"], bucket_tokens).collect()
    want = corpus_by_hand(texts, [i < 240 and i % 2 == 0 for i in range(len(texts))])
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for r in rows:
        n, target, background = want[r.doc_id]
        assert r.text == texts[r.doc_id] and r.n_tokens == n
        assert r.target_loss == (target and pytest.approx(target, abs=1e-5)) and r.background_loss == (background and pytest.approx(background, abs=1e-5))
        assert r.score == pytest.approx((background or 0) - (target or 0), abs=1e-5)
        if r.doc_id < 240:
            assert (r.score > 0) == (r.doc_id % 2 == 0)


def test_corpus_scores_of_odd_tables(awkward, empty):
    rows = cross_entropy.score_corpus(awkward, empty, ["doc_id", "size"]).collect()
    assert len(rows) == awkward.count() and all(r[5] == 0 for r in rows)
    assert cross_entropy.score_corpus(empty, empty, ["doc_id"]).count() == 0


# --- toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_against_distances():
    import random

    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    lexicon = {(word(rng.randint(3, 7)), False): rng.uniform(2, 5) for _ in range(12)} | {(word(9), True): 3.0, (word(4), True): 2.5}
    automaton = toxicity.Automaton(lexicon)
    classes = toxicity._letters().astype(np.int16)
    for c, k in automaton.class_of.items():
        classes[ord(c)] = k
    words = [word(rng.randint(1, 12)) for _ in range(3000)]
    for (term, _) in lexicon:
        for _ in range(40):
            i, kind = rng.randrange(len(term)), rng.randrange(3)
            words.append(term[:i] + ("x" if kind else "") + term[i + (kind < 2):] + rng.choice(["", "", "dd"]))
    codes = toxicity._codes(" ".join(words) + "\x00")
    starts, kinds, weights = automaton.hits(codes, classes[codes])
    found = dict(zip(starts.tolist(), zip(kinds.tolist(), weights.tolist(), strict=True), strict=True))
    at = 0
    for w in words:
        exact = [(v, s) for (t, s), v in lexicon.items() if (w.startswith(t) if s else w == t)]
        near = any(
            any(distance(w[:n], t) <= 1 for n in range(len(w) + 1)) and len(t) >= toxicity.FUZZY_START if s
            else len(t) >= toxicity.FUZZY_WORD and distance(w, t) <= 1
            for (t, s) in lexicon
        )
        want = 1 if exact else 2 if near else 0
        got = found.get(at, (0, 0))[0]
        if not (exact and got == 2 and near):  # a misspelled beginning may end the walk before a longer term
            assert got == want, w
        at += len(w) + 1


@pytest.fixture(scope="module")
def labelled(spark):
    def text(i):
        words = prose(1000 + i, 80, "abcdefgh").split()
        if i % 4 == 0:
            for k in range(6):
                words.insert(7 * k + i % 5, ("dreadfulo", "nastyword", "horridly")[(i + k) % 3])
        return " ".join(words)

    docs = spark.createDataFrame([(i, text(i), "en", "a") for i in range(900)] + [(None, "x", None, None), (5000, None, None, None)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(900)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_toxic_texts_are_found(spark, labelled):
    docs, labels = labelled
    model = toxicity.learn(docs, labels)
    assert {t for t, s in model.lexicon if not s} == {"dreadfulo", "nastyword", "horridly"}
    rows = toxicity.with_score(docs, ["doc_id"], model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    assert len(rows) == 902 and all(0 <= r.score <= 1 for r in rows)
    for r in rows:
        if r.doc_id is not None and r.doc_id < 900:
            assert (r.score >= toxicity.THRESHOLD) == (r.doc_id % 4 == 0)
            assert r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    base = prose(1, 60, "abcdefgh")
    more = spark.createDataFrame([
        ("plain", base), ("abuse", base + " you nastyword and horridly dreadfulo nastyword"), ("misspelt", base + " nastywort horidly nasstyword"),
        ("quoted", base + ' they said "nastyword" and "horridly dreadfulo nastyword" again'),
    ], "name string, text string")
    score = {r.name: r.score for r in toxicity.with_score(more, ["name"], model).collect()}
    assert score["abuse"] > 0.7 > score["quoted"] and score["plain"] < 0.3
    found = {r.name: r["__x"] for r in toxicity.with_features(more, ["name"], model.lexicon).collect()}
    assert found["misspelt"][1] > 0 and found["quoted"][0] == 0 < found["quoted"][2] and found["plain"] == [0.0] * 4


def test_labels_of_held_out_rows_change_nothing(labelled):
    docs, labels = labelled
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, other = toxicity.learn(docs, flipped), toxicity.learn(docs, labels)
    assert one.lexicon == other.lexicon and one.weights == pytest.approx(other.weights) and one.bias == pytest.approx(other.bias)


def test_no_labels_no_scores(awkward, empty, labelled):
    nothing = labelled[1].limit(0)
    model = toxicity.learn(awkward, nothing)
    assert {r.score for r in toxicity.with_score(awkward, ["doc_id"], model).collect()} == {0.0}
    assert toxicity.with_score(empty, ["doc_id"], toxicity.learn(*labelled)).count() == 0


def test_texts_of_cross_entropy_move_compressed(spark):
    """Each text by itself, so that chunks can be read text by text; odd ones come back as they were."""
    texts = ["one two " * 500, "", None, "né 😀 \x00", " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = docs.select(cross_entropy._shrunk(docs["text"]).alias("t")).toArrow().to_batches()
    assert [t for b in rows for _, found in cross_entropy._chunks(b, "t") for t in found] == texts
    assert max(len(t.as_py() or b"") for b in rows for t in b.column("t")) < 100
