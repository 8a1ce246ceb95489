"""Quality rules from compression: texts that shrink too well repeat themselves, texts that hardly shrink are noise.

The ratio raw / compressed (zstandard, UTF-8 bytes) is taken over the whole document and over fixed chunks. How much a
sound text shrinks depends on its length, because the dictionary has to fill first, so the limits do too.
"""

from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

LEVEL = 3
CHUNK = 4096
#: Whole-document limits: the upper one rises with log2 of the bytes; the lower one, by least length.
UPPER_AT_LEAST, UPPER_AT_256, UPPER_PER_DOUBLING = 2.3, 2.15, 0.115
LOWER = ((4096, 1.4), (1024, 1.3), (512, 1.15), (256, 1.05))
#: Limits of a chunk, and the share of chunks outside them that rejects a document.
CHUNK_UPPER, CHUNK_LOWER, CHUNK_SHARE = 3.5, 1.3, 0.25
#: Base rules.
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
SYMBOLS = "#*$%&|<>"
BATCH_ROWS = 1024

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, ratio double, n_chunks int, n_bad_chunks int"
)
NAMES = tuple(c.split()[0] for c in SCHEMA.split(", "))


def upper_limit(n_bytes: int) -> float:
    return max(UPPER_AT_LEAST, UPPER_AT_256 + UPPER_PER_DOUBLING * (log2(n_bytes) - 8)) if n_bytes else UPPER_AT_LEAST


def lower_limit(n_bytes: int) -> float:
    """0 for short texts, where the frame's own bytes hide everything."""
    return next((limit for least, limit in LOWER if n_bytes >= least), 0.0)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside a window of so many words (a power of two) that stands twice or more in the text, the first included.

    Windows get numbers by doubling: a pair of words, then a pair of pairs. Equal numbers mean equal windows, exactly.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    step = 1
    while step < window:
        ids = np.unique(ids[:-step] * (int(ids.max()) + 1) + ids[step:], return_inverse=True)[1]
        step *= 2
    twice = np.bincount(ids)[ids] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def repeated_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def chunk_ratios(raw: bytes, compressor: zstandard.ZstdCompressor) -> list[float]:
    """Ratios of the fixed chunks; a rest shorter than a chunk belongs to the last one. Texts under two chunks have none."""
    count = len(raw) // CHUNK
    if count < 2:
        return []
    cuts = [*range(0, count * CHUNK, CHUNK), len(raw)]
    return [(b - a) / len(compressor.compress(raw[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]


def judge(text: str | None, compressor: zstandard.ZstdCompressor) -> tuple:
    raw = (text or "").encode()
    words = raw.split()
    n_words = len(words)
    blanks = sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\f", b"\r")))
    repeats = repeated_words(words)
    ratio = len(raw) / len(compressor.compress(raw)) if raw else None
    chunks = chunk_ratios(raw, compressor)
    bad = sum(not CHUNK_LOWER <= r <= CHUNK_UPPER for r in chunks)
    failed = n_words < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n_words
    in_band = ratio is not None and lower_limit(len(raw)) <= ratio <= upper_limit(len(raw))
    return (
        n_words, len(text or "") - blanks, sum(map(raw.count, map(str.encode, SYMBOLS))), repeated_lines(raw), repeats, failed,
        not failed and in_band and bad <= CHUNK_SHARE * len(chunks), ratio, len(chunks), bad,
    )


def with_verdict(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns with the counts of the base rules, the compression ratios and `kept`.

    A null or blank text has no words and fails. A text is read whole, whatever its length. Named columns must not clash
    with the added ones. One pass, no shuffle.
    """
    columns, names = list(columns), NAMES

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                found = [judge(t.as_py(), compressor) for t in part.column("__text")]
                added = pa.table({n: pa.array([r[i] for r in found], types[i]) for i, n in enumerate(names)})
                kept = pa.Table.from_batches([part]).select(columns)
                for n in names:
                    kept = kept.append_column(n, added[n])
                yield from kept.to_batches()

    i64, i32 = pa.int64(), pa.int32()
    types = [i64] * 5 + [pa.bool_()] * 2 + [pa.float64(), i32, i32]
    given = docs.select(*columns, docs["text"].alias("__text"))
    kept_fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return given.mapInArrow(score, f"{kept_fields}, {SCHEMA}" if columns else SCHEMA)
