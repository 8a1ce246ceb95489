"""Byte-level BPE over padded numpy matrices.

Texts are cut by the tokenizer's pattern; the distinct pieces of a batch become rows of token ids, bucketed by byte length
and padded. In each round every row merges its leftmost pair of least rank; pairs are looked up in a hash table held in
numpy arrays, rows close up over the merged place, and finished rows leave the matrix. A document's ids are those of its
pieces in order.
"""

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

NONE = np.int32(2**31 - 1)
#: Widths of the matrices; longer pieces get a matrix of their own width.
WIDTHS = (*range(2, 17), 20, 24, 32, 48, 64, 128, 256, 1024)
_WIDTH_OF = [next(w for w in WIDTHS if n <= w) for n in range(WIDTHS[-1] + 1)]
CELLS = 1 << 20
CACHE_PIECES = 300_000
CACHE_CHARS = 64
SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PairTable:
    """Rank of a pair of token ids by open addressing; a slot holds the pair as one 64-bit number."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append(left << 32 | right)
                    values.append(rank)
        size = 1 << max(4, (4 * max(1, len(pairs)) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - size.bit_length() + 1), size - 1
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        left, ranked = np.array(pairs, np.int64), np.array(values, np.int32)
        at = self._slot(left)
        self.most = 1
        while len(left):  # each round the first pair at every free slot stays, the others try the next slot
            free = self.keys[at] == -1
            first = np.zeros(len(left), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.values[at[put]] = left[put], ranked[put]
            left, ranked, at = left[~put], ranked[~put], (at[~put] + 1) & self.mask
            self.most += 1

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        mixed = pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where there is no such token or an id is padding (-1)."""
        pairs = left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF
        pairs = np.where((left < 0) | (right < 0), -2, pairs)
        at = self._slot(pairs)
        seen = self.keys[at]
        out = np.where(seen == pairs, self.values[at], NONE)
        open_ = np.flatnonzero((seen != pairs) & (seen != -1) & (pairs != -2))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            seen = self.keys[at[open_]]
            hit = seen == pairs[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (seen != -1)]
        return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.cut = ranks, regex.compile(pattern)
        self.tokens = {r: t for t, r in ranks.items()}
        self.pair_rank = PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.cache: dict[str, tuple[int, str, bytes]] = {}

    def merge(self, ids: np.ndarray) -> list[list[int]]:
        """Final ids of each row; rows are padded with -1 on the right. The matrix is used up."""
        n, width = ids.shape
        out: list[list[int]] = [[]] * n
        row_of = np.arange(n)
        ranks = np.full((n, width), NONE, np.int32)
        if width > 1:
            ranks[:, :-1] = self.pair_rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        while True:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(at)), at]
            done = best == NONE
            if done.any():
                for k in np.flatnonzero(done):
                    row = ids[k]
                    out[row_of[k]] = row[row >= 0].tolist()
                if done.all():
                    return out
                ids, ranks, row_of, at, best = ids[~done], ranks[~done], row_of[~done], at[~done], best[~done]
                width = int((ids >= 0).sum(axis=1).max())
                ids, ranks = np.ascontiguousarray(ids[:, :width]), np.ascontiguousarray(ranks[:, :width])
            rows = np.arange(len(at))
            ids[rows, at] = best
            if len(at) == 1:  # one long piece: close up in place
                k = int(at[0])
                ids[0, k + 1:-1] = ids[0, k + 2:]
                ranks[0, k + 1:-1] = ranks[0, k + 2:]
            else:
                behind = np.arange(width - 1) > at[:, None]
                ids[:, :-1] = np.where(behind, ids[:, 1:], ids[:, :-1])
                ranks[:, :-1] = np.where(behind, ranks[:, 1:], ranks[:, :-1])
            ids[:, -1], ranks[:, -1] = -1, NONE
            right = np.where(at + 1 < width, ids[rows, np.minimum(at + 1, width - 1)], -1)
            before = np.maximum(at - 1, 0)
            left = np.where(at > 0, ids[rows, before], -1)
            both = self.pair_rank(np.concatenate([ids[rows, at], left]), np.concatenate([right, ids[rows, at]]))
            ranks[rows, at] = both[: len(at)]
            ranks[rows[at > 0], before[at > 0]] = both[len(at):][at > 0]

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece. A piece that is a token itself stays whole, as the rank files are meant."""
        out: list[list[int]] = [[]] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, (piece, whole) in enumerate(zip(pieces, map(self.ranks.get, pieces), strict=True)):
            if whole is not None:
                out[i] = [whole]
            else:
                n = len(piece)
                buckets.setdefault(_WIDTH_OF[n] if n < len(_WIDTH_OF) else n, []).append(i)
        for width, members in buckets.items():
            step = max(1, CELLS // width)
            for start in range(0, len(members), step):
                part = members[start:start + step]
                raw = np.frombuffer(b"".join(pieces[i] for i in part), np.uint8)
                lengths = np.fromiter((len(pieces[i]) for i in part), np.int64, len(part))
                ids = np.full((len(part), width), -1, np.int32)
                ids[np.arange(width) < lengths[:, None]] = self.byte_ids[raw]
                for i, row in zip(part, self.merge(ids), strict=True):
                    out[i] = row
        return out

    def digest(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids, SHA-256 of the ids and SHA-256 of the decoded bytes of each text."""
        cut = [self.cut.findall(t) for t in texts]
        cache = self.cache
        if len(cache) > CACHE_PIECES:
            cache.clear()
        new = list(set().union(*cut).difference(cache))
        encoded = self.encode_pieces([p.encode() for p in new])
        token = self.tokens.__getitem__
        cache.update(
            (p, (len(ids), ",".join(map(str, ids)), b"".join(map(token, ids)))) for p, ids in zip(new, encoded, strict=True)
        )
        out = []
        for pieces in cut:
            counts, ids, raw = zip(*map(cache.__getitem__, pieces), strict=True) if pieces else ((), (), ())
            out.append((
                sum(counts), hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256(b"".join(raw)).hexdigest()
            ))
        for p in new:
            if len(p) > CACHE_CHARS:
                del cache[p]
        return out

    def encode(self, text: str) -> list[int]:
        pieces = self.cut.findall(text)
        ids = self.encode_pieces([p.encode() for p in pieces])
        return [i for row in ids for i in row]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.tokens[i] for i in ids)


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per Python worker; building the tables takes about half a second."""
    return Encoder(load_ranks(path), pattern)


def digests(docs: DataFrame, columns: list[str], path: str, pattern: str, batch_chars: int = 1_000_000) -> DataFrame:
    """The named columns with the number of tokens and digests of ids and decoded bytes. No shuffle.

    A null text counts as empty and has no tokens. Named columns must not clash with the added ones. The vocabulary file
    must lie at `path` on every executor.
    """
    columns = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            found, texts, chars = [], [], 0
            for value in batch.column("__text"):
                text = value.as_py() or ""
                texts.append(text)
                chars += len(text)
                if chars > batch_chars:
                    found += enc.digest(texts)
                    texts, chars = [], 0
            found += enc.digest(texts)
            out = pa.Table.from_batches([batch]).select(columns)
            for i, (name, kind) in enumerate((("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()))):
                out = out.append_column(name, pa.array([f[i] for f in found], kind))
            yield from out.to_batches()

    given = docs.select(*columns, docs["text"].alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return given.mapInArrow(run, f"{kept}, {SCHEMA}" if columns else SCHEMA)
