"""Packing: every id in one place, no padding, steps of one length."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from editlens.llm import packing, queries

PATH = public_tokenizers.path(queries.WORD_VOCABULARY)


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


@given(st.lists(st.sampled_from(
    ["\x1c", "\x85", "\xa0", "é", "É", "́", "İ", "Σ", "a", "Bc", " ", "\t", "\x0b", "\r\n", "'s", "<|endoftext|>", "ﬁ", "日本", "1", "٣", "\x00", "🙂", ".", "!?", "ß"]
), max_size=14))
@settings(max_examples=400, deadline=None)
def test_words_one_by_one(tokenizer, parts):
    text = "".join(parts)
    got = np.frombuffer(packing.word_ids(PATH).of(text), "<u4").tolist()
    assert got == tokenizer.encode(text, add_special_tokens=False).ids


@given(st.lists(st.one_of(st.integers(1, 40), st.integers(1, 5000), st.integers(1, 20_000)), max_size=60))
@settings(max_examples=300, deadline=None)
def test_blocks(lengths):
    sequences = packing.pack_block(np.array(lengths, np.int64))
    pieces = defaultdict(list)
    for s in sequences:
        size = sum(p[2] for p in s)
        assert size <= packing.WINDOW and size & size - 1 == 0
        for doc, start, length in s:
            assert length > 0
            pieces[doc].append((start, length))
    for doc, n in enumerate(lengths):
        at = 0
        for start, length in sorted(pieces[doc]):
            assert start == at
            at += length
        assert at == n
    small = sum(1 for s in sequences if sum(p[2] for p in s) < packing.LEAST)
    assert small <= 9  # only the binary digits of the last window
    step = packing.steps(sequences, 1 << 14)
    per = defaultdict(list)
    for s, k in zip(sequences, step, strict=True):
        per[k].append(sum(p[2] for p in s))
    assert all(len(set(v)) == 1 and sum(v) <= 1 << 14 for v in per.values())
    full = sum(1 for v in per.values() if sum(v) == 1 << 14)
    assert len(per) - full <= len({sum(p[2] for p in s) for s in sequences})


def test_long_documents_keep_whole_windows_and_short_ones_fill_gaps():
    sequences = packing.pack_block(np.array([3000, 900, 196, 8192 + 700, 300, 24]))
    assert [(0, 0, 3000), (1, 0, 900), (2, 0, 196)] in sequences
    assert [(3, 0, 4096)] in sequences and [(3, 4096, 4096)] in sequences
    assert [(3, 8192, 700), (4, 0, 300), (5, 0, 24)] in sequences


def test_steps_go_by_cost():
    one, two = [(0, 0, 1024)], [(1, 0, 512), (2, 0, 512)]
    step = packing.steps([one, two, one, two], 2048)
    assert step[0] == step[2] != step[1] == step[3]


def check(rows, docs, tokenizer):
    """Pieces of each document in any order of equal keys, and sequences without gaps."""
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        at = 0
        for r in s:
            assert r.offset == at and len({x.step_id for x in s}) == 1
            at += r.length
        assert at == s[0].sequence_length and at & at - 1 == 0
    want = defaultdict(int)
    for r in docs:
        n = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
        want[r.doc_id] += n
    got = defaultdict(int)
    for r in rows:
        got[r.doc_id] += r.length
    assert got == want


def test_awkward_documents(awkward, tokenizer):
    rows = packing.pack(awkward, ["doc_id", "size"], PATH, 2, block_tokens=20_000, step_tokens=8192).collect()
    docs = awkward.collect()
    check(rows, docs, tokenizer)
    assert {r.size for r in rows} == {"s"}
    empty = [r for r in rows if r.doc_id in (4, 5, 6)]
    assert [(r.length, r.ids, r.doc_tokens) for r in empty] == [(1, b"\x02\0\0\0", 1)] * 3
    for r in docs:
        if r.doc_id in (9, 13):
            whole = np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 2], "<u4").tobytes()
            mine = sorted((x for x in rows if x.doc_id == r.doc_id), key=lambda x: x.start)
            assert b"".join(x.ids for x in mine) == whole


def test_no_documents(empty):
    frame = packing.pack(empty, ["doc_id"], PATH, 2)
    assert frame.count() == 0 and "step_id" in frame.columns


def test_query_on_a_table(spark, tokenizer):
    folder = "/root/testdata/sf0.001"
    rows = queries.op11_hierarchical_packing(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    check(rows, docs, tokenizer)
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for d in docs:
        ids = np.array([*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 2], "<u4")
        for r in by_doc[d.doc_id]:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())


def test_texts_are_not_shuffled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = packing.pack(docs, ["doc_id"], PATH, 2).withColumn("c", F.crc32("ids"))._jdf.queryExecution().toString()
    assert "Exchange" not in plan
