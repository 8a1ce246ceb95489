"""Embedding whitening fitted on weighted distinct vectors.

Entries become whole numbers on a grid. Equal grid vectors are grouped; each counts once in the fit, or as often as it occurs.
Sums are exact; the covariance is a product of centred matrices, per task, added up row by row. The driver sees one d x d
matrix (d is the dimension, whatever the number of rows) for its eigenvectors. Each distinct vector is projected once,
and the rows get the result by a join on a digest of the grid vector.

Rows without a vector, with a null or non-finite entry, or with an entry off the range of a long are dropped, and so are
rows whose vector has another length than most (of equally frequent lengths the greater counts). Components without
variance are left out. Repeated rows stay repeated. An empty table gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editlens.session import materialize

#: Grid steps per unit.
GRID = 256
COMPONENTS = 4
#: A vector with more than this share of the rows, and this many rows, is joined in parts: so there are 1,000 at most.
HOT_SHARE, HOT_ROWS = 1000, 10_000
WIDTHS = ("<i2", "<i4", "<i8")


def _grid(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the usable rows and their grid vectors, one matrix per length."""
    vectors = vectors.cast(pa.list_(pa.float64()))
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == d)
        values = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d) * float(GRID)
        good = (np.abs(values) < 2.0**62).all(axis=1)  # false for null, which arrives as NaN, and for infinite
        yield rows[good], np.floor(values[good]).astype(np.int64)


def _as_bytes(x: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Rows and their bytes in the narrowest whole type that holds all entries of the row: equal vectors, equal bytes."""
    top = np.maximum(x, ~x).max(axis=1)
    kind = np.searchsorted([1 << 15, 1 << 31], top, side="right")
    for k in np.unique(kind):
        rows = np.flatnonzero(kind == k)
        packed = np.ascontiguousarray(x[rows].astype(WIDTHS[k]))
        width = packed.shape[1] * packed.itemsize
        fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(packed.tobytes())])
        yield rows, fixed.cast(pa.binary())


def _matrix(x: pa.Array, d: int) -> np.ndarray:
    """The grid vectors of a batch as 64-bit numbers."""
    out = np.empty((len(x), d), np.int64)
    sizes = np.asarray(pc.binary_length(x))
    for kind in WIDTHS:
        rows = np.flatnonzero(sizes == d * np.dtype(kind).itemsize)
        if len(rows):
            out[rows] = np.frombuffer(b"".join(x.take(pa.array(rows)).to_pylist()), kind).reshape(-1, d)
    return out


def grid_vectors(df: DataFrame, columns: list[str], vector: str) -> DataFrame:
    """Named columns of the usable rows with `x`, the packed grid vector, and `dim`, its length."""
    columns = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _grid(batch.column("__vector")):
                for some, packed in _as_bytes(x) if len(rows) else ():
                    kept = batch.select(columns).take(pa.array(rows[some]))
                    dim = pa.array(np.full(len(some), x.shape[1], np.int32))
                    yield pa.RecordBatch.from_arrays([*kept.columns, packed, dim], [*columns, "x", "dim"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*columns).schema)
    return df.select(*columns, df[vector].alias("__vector")).mapInArrow(run, f"{kept} x binary, dim int")


def _sums(distinct: DataFrame, d: int) -> tuple[int, list[int]]:
    """Total weight and weighted sum of each dimension, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = 0, [0] * d
        for batch in batches:
            x, w = _matrix(batch.column("x"), d), np.asarray(batch.column("weight"))
            top = int(np.abs(x).max(initial=0)) * int(w.sum())
            part = (w @ x) if top < 1 << 62 else (w.astype(object) @ x.astype(object))
            total += int(w.sum())
            sums = [a + int(b) for a, b in zip(sums, part, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-1, d), pa.int32()), pa.array([total, *sums], pa.decimal128(38, 0))], ["dim", "s"]
        )

    rows = distinct.select("x", "weight").mapInArrow(run, "dim int, s decimal(38,0)").groupBy("dim").agg(F.sum("s").alias("s"))
    found = {r.dim: int(r.s) for r in rows.collect()}  # one number per dimension
    return found.get(-1, 0), [found.get(i, 0) for i in range(d)]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n: the whole part of the mean goes off before rounding to doubles."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(np.float64) - rest


def _covariance(distinct: DataFrame, d: int, n: int, sums: list[int]) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            y = _centred(_matrix(batch.column("x"), d), n, sums)
            total += (y * np.asarray(batch.column("weight"), np.float64)[:, None]).T @ y
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(d), pa.int32()), pa.array([part] * d, pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())],
            ["dim", "part", "row"],
        )

    def add(group: pa.Table) -> pa.Table:
        """The tasks' rows of one dimension, added in the order of the tasks, so that reruns agree."""
        ordered = group.sort_by("part")
        row = np.zeros(d)
        for part in ordered.column("row").to_pylist():
            row += np.frombuffer(part)
        return pa.table({"dim": ordered.column("dim").slice(0, 1), "row": pa.array([row.tobytes()], pa.binary())})

    parts = distinct.select("x", "weight").mapInArrow(run, "dim int, part int, row binary")
    rows = parts.groupBy("dim").applyInArrow(add, "dim int, row binary").collect()  # d rows of d numbers
    return np.array([np.frombuffer(r.row) for r in sorted(rows, key=lambda r: r.dim)]) / n


def principal_axes(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from the greatest on and unit eigenvectors as columns, whose largest entry is positive."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    usable = values > len(values) * np.finfo(float).eps * max(values[0], 0.0)
    values, vectors = values[usable][:components], vectors[:, usable][:, :components]
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return values, vectors * np.where(largest < 0, -1.0, 1.0)


def _projected(distinct: DataFrame, d: int, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """Each distinct vector with its exact deviation and its whitened components."""
    onto = vectors / np.sqrt(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            top = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
            whole = np.int64 if d * top * top < 1 << 62 else object
            off = n * x.astype(whole) - np.array(sums, whole)
            deviation = pa.array([int(v) for v in (off * off).sum(axis=1)], pa.decimal128(38, 0))
            white = _centred(x, n, sums) @ onto
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * onto.shape[1], pa.array(white.ravel()))
            kept = [batch.column(c) for c in ("key", "copies", "weight")]
            yield pa.RecordBatch.from_arrays([*kept, deviation, lists], ["key", "copies", "weight", "deviation", "white"])

    return distinct.select("x", "key", "copies", "weight").mapInArrow(
        run, "key binary, copies long, weight long, deviation decimal(38,0), white array<double>"
    )


def _identity_error(white: DataFrame, k: int, n: int) -> float:
    """Largest absolute entry of the weighted covariance of the whitened vectors, less the identity."""
    w, c = F.col("weight"), [F.col("white")[i] for i in range(k)]
    means = white.agg(*[(F.sum(w * c[i]) / n).alias(f"m{i}") for i in range(k)]).first()
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    found = white.agg(*[
        (F.sum(w * (c[i] - F.lit(means[i])) * (c[j] - F.lit(means[j]))) / n).alias(f"v{i}_{j}") for i, j in pairs
    ]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs, strict=True))


def _join_back(rows: DataFrame, white: DataFrame, total: int) -> DataFrame:
    """Every row with the result of its vector. A frequent vector's rows are dealt to as many tasks as it needs.

    At most HOT_SHARE vectors have more than one part in HOT_SHARE of the rows, so that many keys are broadcast at most.
    """
    most = max(total // HOT_SHARE, HOT_ROWS)
    parts = F.ceil(F.col("copies") / F.lit(most)).cast("int")
    hot = F.broadcast(white.where(F.col("copies") > most).select("key", parts.alias("__parts")))
    dealt = rows.join(hot, "key", "left").withColumn(
        "__part", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("__parts")), F.lit(0)).cast("int")
    )
    spread = white.select(
        "key", "deviation", "white", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)).alias("__part")
    )
    return dealt.drop("__parts").join(spread, ["key", "__part"]).drop("key", "__part")


def whiten(
    df: DataFrame, columns: list[str], vector: str, components: int = COMPONENTS, count_copies: bool = False
) -> DataFrame:
    """The named columns of each usable row, once per component: `component` (from 1, by falling eigenvalue), `n` (weight of
    the fit), `deviation` (sum of the squares of n*x - S, exact), `whitened`, `explained` and `identity_error`.

    A distinct vector weighs one, or with `count_copies` as much as it has rows. Named columns must not clash with the added.
    """
    key = F.unhex(F.sha2("x", 256)).alias("key")
    distinct = grid_vectors(df, [], vector).groupBy("x", "dim").agg(F.count(F.lit(1)).alias("copies"))
    weight = F.col("copies") if count_copies else F.lit(1).cast("long")
    distinct = materialize(distinct.select("x", "dim", "copies", weight.alias("weight"), key), "grid-vectors")
    by_length = distinct.groupBy("dim").agg(F.sum("copies").alias("n"))
    best = by_length.agg(F.max_by(F.struct("dim", "n"), F.struct("n", "dim")).alias("b")).first().b
    d, total = (best.dim, best.n) if best else (0, 0)
    fit = distinct.where(F.col("dim") == d)
    n, sums = _sums(fit, d)
    rows = grid_vectors(df, columns, vector).where(F.col("dim") == d).select(*columns, key)
    values, vectors, trace = np.zeros(0), np.zeros((d, 0)), 0.0
    if n:
        covariance = _covariance(fit, d, n, sums)
        values, vectors = principal_axes(covariance, components)
        trace = float(np.trace(covariance))
    if not len(values):  # no rows, or all vectors are equal
        none = {"component": "int", "n": "long", "deviation": "decimal(38,0)", "whitened": "double", "explained": "double", "identity_error": "double"}
        return rows.limit(0).select(*columns, *[F.lit(None).cast(kind).alias(name) for name, kind in none.items()])
    white = materialize(_projected(fit, d, n, sums, values, vectors), "whitened")
    error = _identity_error(white, len(values), n)
    explained = F.array(*[F.lit(float(v / trace)) for v in values])
    joined = _join_back(rows, white, total)
    return joined.select(*columns, "deviation", F.posexplode("white").alias("__i", "whitened")).select(
        *columns, (F.col("__i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("__i")).alias("explained"), F.lit(error).alias("identity_error"),
    )
