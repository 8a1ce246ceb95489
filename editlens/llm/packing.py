"""Hierarchical packing of documents into training sequences of several lengths.

Documents are cut into whole windows and a rest; a rest belongs to the shortest tier (a power of two) that holds it. Tiers
are packed from the longest down: a document opens a window of its tier, and the gap behind it is filled from the shorter
tiers, the longest document that fits first. Only what no whole document fits is cut to length. The last window of a block is
cut at the binary digits of its length, so no sequence needs padding. Sequences of one length are then put in order of
their attention cost and dealt into steps of equal token counts, so that the sequences of a step cost about the same.

Blocks of consecutive documents are packed by the task that has tokenized them: nothing is shuffled, ids are made once, and
a block holds `block_tokens` ids (or one longer document). Every token of every document is in exactly one piece. A null
or empty text is the end id alone. Rows with the same key are packed apart from each other, each for itself.
"""

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

WINDOW = 4096
#: The shortest tier; a rest below it waits as a filler.
LEAST = 512
BLOCK_TOKENS = 4_000_000
#: Tokens of a step; every step holds sequences of one length.
STEP_TOKENS = 1 << 16
CACHE_WORDS = 1_200_000
CACHE_BYTES = 48
#: ASCII marks at the end of a word that the tokenizer always splits off from a letter or digit before them.
MARKS = b".,;:!?"
#: Lower-case words of Latin-1 letters are one piece to the tokenizer and normal as they are.
PLAIN = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+")
SCHEMA = (
    "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length int, step_id long"
)


def byte_letters() -> dict[int, str]:
    """The letter a byte-level vocabulary writes for each byte: visible ones stand for themselves, the rest follow from 256."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordIds(dict):
    """Token ids of words as little-endian 32-bit bytes; a word is given to the tokenizer when it is first met.

    The tokenizer never joins across white space and lower-cases itself, so words can be taken one by one, in lower case.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model, self.letters = self.tokenizer.model, byte_letters()

    def _encode(self, raw: bytes) -> bytes:
        word = raw.decode()
        if PLAIN.fullmatch(word):
            ids = [t.id for t in self.model.tokenize(raw.decode("latin-1").translate(self.letters))]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        core = word.rstrip(MARKS)
        if core and len(core) < len(word) and core[-1:].isalnum():
            ids = self[core] + self[word[len(core):]]
        else:
            ids = self._encode(word)
        if len(word) <= CACHE_BYTES:
            self[word] = ids
        return ids

    def of(self, text: str) -> bytes:
        if len(self) > CACHE_WORDS:
            self.clear()
        return b"".join(map(self.__getitem__, text.encode().lower().split()))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


class Pool:
    """Rests that wait for a place, by length. A bit per length finds the longest that fits."""

    def __init__(self):
        self.by_length: dict[int, list[tuple[int, int]]] = {}
        self.lengths = 0

    def put(self, length: int, doc: int, start: int) -> None:
        self.by_length.setdefault(length, []).append((doc, start))
        self.lengths |= 1 << length

    def longest(self, most: int) -> int:
        """Length of the longest rest of at most `most` tokens; 0 if there is none."""
        fitting = self.lengths & (1 << (most + 1)) - 1
        return max(fitting.bit_length() - 1, 0)

    def take(self, length: int) -> tuple[int, int]:
        rests = self.by_length[length]
        found = rests.pop()
        if not rests:
            self.lengths &= ~(1 << length)
        return found

    def cut(self, size: int) -> tuple[int, int] | None:
        """The first `size` tokens of the longest rest; what is left of it waits on."""
        length = self.longest(WINDOW)
        if length <= size:
            return None
        doc, start = self.take(length)
        self.put(length - size, doc, start + size)
        return doc, start


Piece = tuple[int, int, int]  # document of the block, its ids before the piece, length


def fill(pool: Pool, tier: int) -> list[Piece]:
    """One window of a tier: the longest rest of the tier, and what fills its gap."""
    window, gap = [], tier
    while gap:
        length = pool.longest(gap)
        found = pool.take(length) if length else pool.cut(gap)
        if found is None:
            break
        length = length or gap
        window.append((*found, length))
        gap -= length
    return window


def binary_cut(window: list[Piece]) -> Iterator[list[Piece]]:
    """The pieces of a window that is not full as sequences whose lengths are powers of two, the longest first."""
    left, waiting = sum(p[2] for p in window), list(reversed(window))
    while left:
        size = room = 1 << left.bit_length() - 1
        sequence = []
        while room:
            doc, start, length = waiting.pop()
            if length > room:
                waiting.append((doc, start + room, length - room))
            sequence.append((doc, start, min(length, room)))
            room -= sequence[-1][2]
        left -= size
        yield sequence


def pack_block(lengths: np.ndarray) -> list[list[Piece]]:
    """Sequences of a block of documents. Only powers of two from 1 to the window occur as lengths."""
    sequences: list[list[Piece]] = []
    pool = Pool()
    for doc, n in enumerate(lengths.tolist()):
        whole = n // WINDOW * WINDOW
        sequences += [[(doc, start, WINDOW)] for start in range(0, whole, WINDOW)]
        if n > whole:
            pool.put(n - whole, doc, whole)
    tier = WINDOW
    while pool.lengths:
        if tier > LEAST and pool.longest(WINDOW) <= tier // 2:
            tier //= 2  # the rests that are left belong to a shorter tier
            continue
        window = fill(pool, tier)
        sequences += [window] if sum(p[2] for p in window) == tier else binary_cut(window)
    return sequences


def steps(sequences: list[list[Piece]], step_tokens: int) -> list[int]:
    """Number of the step of each sequence: sequences of one length, in order of the sum of squared piece lengths."""
    size = [sum(p[2] for p in s) for s in sequences]
    cost = [sum(p[2] * p[2] for p in s) for s in sequences]
    out, step, held, last = [0] * len(sequences), -1, 0, None
    for i in sorted(range(len(sequences)), key=lambda i: (-size[i], -cost[i], i)):
        if size[i] != last or held + size[i] > step_tokens:
            step, held, last = step + 1, 0, size[i]
        held += size[i]
        out[i] = step
    return out


def pack(
    docs: DataFrame, columns: list[str], path: str, end_id: int, block_tokens: int = BLOCK_TOKENS,
    step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """One row per piece: the named columns, place in the document and in its sequence, ids as 32-bit little-endian bytes.

    `docs` should be a scan: sequence and step ids carry the number of the task's partition, which a repeated task has
    again. The tokenizer file must lie at `path` on every executor. Named columns must not clash with the added ones.
    """
    columns = list(columns)
    kept = docs.select(*columns)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), SCHEMA])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = word_ids(path).of, np.array([end_id], "<u4").tobytes()
        first = TaskContext.get().partitionId() << 33
        sequence_base = step_base = first

        def packed(keys: list[pa.RecordBatch], ids: list[bytes]) -> pa.Table:
            nonlocal sequence_base, step_base
            lengths = np.fromiter((len(i) // 4 for i in ids), np.int64, len(ids))
            sequences = pack_block(lengths)
            step_of = steps(sequences, step_tokens)
            doc, start, length, sequence, offset, size = [], [], [], [], [], []
            for n, pieces in enumerate(sequences):
                at = 0
                for d, s, k in pieces:
                    doc.append(d)
                    start.append(s)
                    length.append(k)
                    sequence.append(n)
                    offset.append(at)
                    at += k
                size += [at] * len(pieces)
            sequence = np.array(sequence, np.int64)
            step = np.array(step_of, np.int64)[sequence]
            added = {
                "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
                "ids": pa.array([ids[d][4 * s:4 * (s + k)] for d, s, k in zip(doc, start, length, strict=True)], pa.binary()),
                "doc_tokens": pa.array(lengths[doc], pa.int64()), "sequence_id": pa.array(sequence + sequence_base),
                "offset": pa.array(offset, pa.int64()), "sequence_length": pa.array(size, pa.int32()),
                "step_id": pa.array(step + step_base),
            }
            sequence_base += len(sequences)
            step_base += int(step.max()) + 1
            taken = pa.Table.from_batches(keys).take(pa.array(doc, pa.int64())) if columns else None
            all_columns = {c: taken.column(c).combine_chunks() for c in columns} | added
            return pa.Table.from_pydict(all_columns)

        keys, ids, held = [], [], 0
        for batch in batches:
            start = 0
            for at, text in enumerate(batch.column("__text")):
                ids.append(ids_of(text.as_py() or "") + end)
                held += len(ids[-1]) // 4
                if held >= block_tokens:
                    keys.append(batch.slice(start, at + 1 - start).select(columns))
                    yield from packed(keys, ids).to_batches(max_chunksize=10_000)
                    keys, ids, held, start = [], [], 0, at + 1
            keys.append(batch.slice(start).select(columns))
        if ids:
            yield from packed(keys, ids).to_batches(max_chunksize=10_000)

    return docs.select(*columns, docs["text"].alias("__text")).mapInArrow(run, schema)
