"""Whitening against numpy on the whole table and on hand-made rows."""

import math

import numpy as np
import pytest

from editlens.llm import queries, whitening


def brute(vectors, components=4, count_copies=False):
    """Grid vectors, n, sums, eigenvalues, axes and the trace."""
    x = [tuple(math.floor(256 * float(c)) for c in v) for v in vectors]
    fit = np.array(x if count_copies else sorted(set(x)), np.int64)
    n, sums = len(fit), fit.sum(axis=0)
    y = fit - sums / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    return np.array(x), n, sums, values[::-1][:components], axes[:, ::-1][:, :components], values.sum()


def usable(v, d):
    return v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)


def compare(rows, named, count_copies=False):
    x, n, sums, values, axes, trace = brute([v for _, v in named], count_copies=count_copies)
    white = (x - sums / n) @ axes / np.sqrt(values)
    want = sorted((i, c + 1) for i, _ in named for c in range(len(values)))
    assert sorted((r.vec_id, r.component) for r in rows) == want
    at = {i: k for k, (i, _) in enumerate(named)}
    sign = {}
    for r in rows:
        w = white[at[r.vec_id], r.component - 1]
        if abs(w) > 1e-3:
            assert sign.setdefault(r.component, np.sign(w * r.whitened)) == np.sign(w * r.whitened)
        assert abs(abs(r.whitened) - abs(w)) < 1e-8
        assert r.n == n and int(r.deviation) == sum(int(a) ** 2 for a in n * x[at[r.vec_id]] - sums)
        assert abs(r.explained / (values[r.component - 1] / trace) - 1) < 1e-9
        assert r.identity_error < 1e-9
    assert len({r.identity_error for r in rows}) == 1


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    compare(queries.op12_weighted_whitening(spark, folder).collect(), [(r.vec_id, r.embedding) for r in table if usable(r.embedding, 64)])


SCHEMA = "vec_id long, v array<double>, deviation string, n string"


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=5)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]  # a third of the rows are one vector
    rows += [(2000 + i, [float(c) + 1e-7 for c in rows[9][1]]) for i in range(3)]
    rows += [(3000, [150.0, -0.0, 3.5, 0.0, -0.0]), (3001, [-0.001, 200.0, -200.0, 129.0, -129.0])]  # wider numbers
    bad = [(4000, None), (4001, [1.0, None, 2.0, 3.0, 4.0]), (4002, [math.nan] * 5), (4003, [math.inf, 0.0, 0.0, 0.0, 0.0]),
           (4004, []), (4005, [1.0, 2.0]), (4006, [1e300, 0.0, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(i, v, "d", "n") for i, v in rows + bad], SCHEMA).repartition(4)
    return frame, rows


@pytest.mark.parametrize("count_copies", [False, True])
def test_made_up_rows(made, count_copies, monkeypatch):
    monkeypatch.setattr(whitening, "HOT_ROWS", 20)  # the frequent vector is joined in parts
    frame, rows = made
    compare(whitening.whiten(frame, ["vec_id"], "v", count_copies=count_copies).collect(), rows, count_copies)


def test_repeated_rows_and_null_ids(spark):
    rows = [(None, [1.0, 2.0]), (None, [1.0, 2.0]), (1, [2.0, 2.0]), (1, [0.0, 5.0])]
    got = whitening.whiten(spark.createDataFrame([(i, v, "", "") for i, v in rows], SCHEMA), ["vec_id"], "v").collect()
    assert len(got) == 8 and sum(r.vec_id is None for r in got) == 4 and {r.n for r in got} == {3}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(spark, rows):
    frame = whitening.whiten(spark.createDataFrame([(i, v, "", "") for i, v in rows], SCHEMA), ["vec_id"], "v")
    assert frame.collect() == [] and frame.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_flat_dimension_gives_fewer_components(spark):
    rows = [(i, [float(i % 7), float(i * i % 11), 3.0], "", "") for i in range(40)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA), ["vec_id"], "v").collect()
    assert {r.component for r in got} == {1, 2}


def test_packed_grid_vectors():
    x = np.array([[0, -1, 32767], [0, -32768, 5], [1, 32768, 0], [0, -(1 << 31), 9], [1 << 31, 0, 0], [-(1 << 61), 2, 3]])
    for rows, packed in whitening._as_bytes(x):
        assert (whitening._matrix(packed, 3) == x[rows]).all()
