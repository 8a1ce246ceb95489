"""Cross-entropy difference: how much better a target model predicts a text than a background model does, per token.

Both models are bigram models with the same vocabulary, smoothing and mass (background counts are scaled to the target's
total), so their losses differ only by what they have read: the target texts, or the whole corpus. Counts cover every
document.

`score_corpus` scores the documents the models are learned from. Every word is a word of its own, as a 64-bit hash, so the
model grows with the corpus; it is never in one place. Every token is the first word of one bigram and the second of one,
so the loss of a text is a sum over its bigrams of log(count of second word + PRIOR) - log(count of bigram + PRIOR × share
of second word): all counts it needs meet where the bigrams of a second word meet. Bigrams travel in packed lists between
chunks of documents and buckets of second words. A word with more than a quarter of a bucket's tokens is spread by its
first word, and its counts, no more than four for each bucket, go to every task.

`learn` and `with_score` are for texts that the models have not read: the vocabulary is the corpus's most frequent words,
other words fall into classes by shape, and the model is two tables of VOCABULARY² losses.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from editlens.session import materialize

VOCABULARY = 2048
#: Shapes of words outside the vocabulary: length (5) × first byte is not a letter, last byte is not a letter, has a
#: digit, has a byte beyond ASCII. Id 0 is the edge of a text.
SHAPES = 5 * 16
PRIOR = 100.0
PENDING = 500_000
BATCH_CHARS = 1_000_000
#: Tokens of a bucket, on average, and the most text and documents of a chunk.
BUCKET_TOKENS = 2_000_000
CHUNK_CHARS, CHUNK_DOCS = 2_000_000, 60_000


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _shape(word: bytes) -> int:
    n = len(word)
    size = 0 if n < 4 else 1 if n < 7 else 2 if n < 10 else 3 if n < 14 else 4
    letter = lambda b: b >= 128 or chr(b).isalpha()
    return 1 + size * 16 + 8 * (not letter(word[0])) + 4 * (not letter(word[-1])) + 2 * any(48 <= b < 58 for b in word) + (not word.isascii())


def count_words(docs: DataFrame) -> DataFrame:
    """word (binary), n over all texts. Each task adds up first and lets go of its sums when they become many."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column("text"):
                seen.update(_words(text.as_py()))
                if len(seen) > PENDING:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def shared_vocabulary(docs: DataFrame, size: int = VOCABULARY) -> dict[bytes, int]:
    """The most frequent words, ties by bytes, numbered after the shapes. The number of ids is `size`."""
    room = size - 1 - SHAPES
    rows = count_words(docs).orderBy(F.col("n").desc(), "word").limit(room).collect()
    return {bytes(r["word"]): 1 + SHAPES + i for i, r in enumerate(rows)}


class Ids(dict):
    """Word → id; a word outside the vocabulary gets its shape. The memory of such words is emptied when it grows."""

    def __init__(self, vocabulary: dict[bytes, int]):
        super().__init__(vocabulary)
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> int:
        if len(self) > PENDING:
            self.clear()
            self.update(self.vocabulary)
        self[word] = shape = _shape(word)
        return shape

    def pairs(self, texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Bigrams of all texts as numbers, edges included, and how many each text has; a text without words has none."""
        found = [list(map(self.__getitem__, _words(t))) for t in texts]
        n = np.fromiter((len(f) + 1 if f else 0 for f in found), np.int64, len(found))
        flat: list[int] = [0]
        for f in found:
            if f:
                flat += f
                flat.append(0)
        ids = np.array(flat, np.int64)
        return ids[:-1] * size + ids[1:], n


def count_pairs(texts: DataFrame, vocabulary: dict[bytes, int], size: int) -> DataFrame:
    """pair, target and background counts of `texts` (text, is_target); the background is every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(vocabulary)
        sums = np.zeros((2, size * size), np.int32)
        for batch in batches:
            rows, chars = [], 0
            values = list(zip(batch.column("text"), batch.column("is_target"), strict=True))
            for k, (text, is_target) in enumerate(values):
                rows.append((text.as_py(), is_target.as_py()))
                chars += len(rows[-1][0] or "")
                if chars > BATCH_CHARS or k == len(values) - 1:
                    pairs, n = ids.pairs([r[0] for r in rows], size)
                    mine = np.repeat(np.fromiter((bool(r[1]) for r in rows), bool, len(rows)), n)
                    np.add.at(sums[0], pairs[mine], 1)
                    np.add.at(sums[1], pairs, 1)
                    rows, chars = [], 0
        at = np.flatnonzero(sums[1])
        for start in range(0, len(at), PENDING):
            part = at[start:start + PENDING]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), *[pa.array(s[part].astype(np.int64)) for s in sums]], ["pair", "target", "background"]
            )

    counted = texts.select("text", "is_target").mapInArrow(run, "pair int, target long, background long")
    return counted.groupBy("pair").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


def losses(counts: np.ndarray, size: int, prior: float = PRIOR) -> np.ndarray:
    """-log p(word | word before) for every pair of ids; a context's counts are filled up by `prior` unigram counts."""
    table = counts.reshape(size, size).astype(np.float64)
    single = table.sum(axis=0) + 0.5
    single /= single.sum()
    table += prior * single
    table /= table.sum(axis=1, keepdims=True)
    return -np.log(table).astype(np.float32).ravel()


def learn(docs: DataFrame, targets: DataFrame, size: int = VOCABULARY) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
    """Vocabulary and loss tables of target and background. `targets` holds the doc_ids of the target texts.

    Without target words both tables are the background's, so every difference is 0.
    """
    vocabulary = shared_vocabulary(docs, size)
    marks = targets.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().withColumn("is_target", F.lit(True))
    # labels grow with the documents, so the join shuffles both sides at any size
    texts = docs.select("doc_id", "text").join(marks.hint("merge"), "doc_id", "left")
    found = count_pairs(texts, vocabulary, size).toArrow()
    sums = np.zeros((2, size * size), np.float64)
    at = found.column("pair").to_numpy()
    for k, name in enumerate(("target", "background")):
        sums[k, at] = found.column(name).to_numpy()
    if not sums[0].any():
        sums[0] = sums[1]
    elif sums[1].any():
        sums[1] *= sums[0].sum() / sums[1].sum()
    return vocabulary, losses(sums[0], size), losses(sums[1], size)


def with_score(docs: DataFrame, columns: list[str], model: tuple[dict[bytes, int], np.ndarray, np.ndarray], size: int = VOCABULARY) -> DataFrame:
    """The named columns with n_tokens, target_loss, background_loss (nats per token) and score, their difference.

    A higher score means closer to the target. A null or blank text has no tokens, null losses and score 0.
    """
    columns, (vocabulary, target, background) = list(columns), model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(vocabulary)

        def score(texts: list[str | None]) -> np.ndarray:
            pairs, n = ids.pairs(texts, size)
            ends = np.concatenate([[0], np.cumsum(n)])
            out = np.zeros((3, len(texts)))
            out[0] = n
            for k, table in ((1, target), (2, background)):
                total = np.concatenate([[0.0], np.cumsum(table[pairs], dtype=np.float64)])
                out[k] = (total[ends[1:]] - total[ends[:-1]]) / np.maximum(n, 1)
            return out

        for batch in batches:
            parts, texts, chars = [], [], 0
            for value in batch.column("__text"):
                texts.append(value.as_py())
                chars += len(texts[-1] or "")
                if chars > BATCH_CHARS:
                    parts.append(score(texts))
                    texts, chars = [], 0
            parts.append(score(texts))
            n, of_target, of_background = np.concatenate(parts, axis=1)
            blank = n == 0
            out = pa.Table.from_batches([batch]).select(columns)
            out = out.append_column("n_tokens", pa.array(np.maximum(n - 1, 0).astype(np.int64)))
            out = out.append_column("target_loss", pa.array(of_target, mask=blank))
            out = out.append_column("background_loss", pa.array(of_background, mask=blank))
            out = out.append_column("score", pa.array(np.where(blank, 0.0, of_background - of_target)))
            yield from out.to_batches()

    given = docs.select(*columns, docs["text"].alias("__text"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*columns).schema)
    return given.mapInArrow(run, f"{kept}n_tokens long, target_loss double, background_loss double, score double")


class Hashes(dict):
    """Word → 64-bit hash, never 0, which is the edge of a text. Its memory is emptied when it grows."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > PENDING:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word) or 1
        return h

    def bigrams(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and second words of all bigrams, edges included, and how many each text has; a text without words has none."""
        found = [list(map(self.__getitem__, _words(t))) for t in texts]
        n = np.fromiter((len(f) + 1 if f else 0 for f in found), np.int64, len(found))
        flat: list[int] = [0]
        for f in found:
            if f:
                flat += f
                flat.append(0)
        ids = np.array(flat, np.uint64)
        return ids[:-1], ids[1:], n


@F.arrow_udf(T.BinaryType())
def _shrunk(texts: pa.Array) -> pa.Array:
    """Each text compressed by itself, for a shuffle: a third less than Spark's own compression leaves."""
    z = zstandard.ZstdCompressor(level=1)
    return pa.array([z.compress(t.as_py().encode()) if t.is_valid else None for t in texts], pa.binary())


def _chunks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[str | None]]]:
    """The texts of a batch, plain or `_shrunk`, in chunks, each with the place of its first row."""
    start, texts, chars, z = 0, [], 0, zstandard.ZstdDecompressor()
    for value in batch.column(column):
        text = value.as_py()
        texts.append(z.decompress(text).decode() if isinstance(text, bytes) else text)
        chars += len(texts[-1] or "")
        if chars > CHUNK_CHARS or len(texts) == CHUNK_DOCS:
            yield start, texts
            start, texts, chars = start + len(texts), [], 0
    if texts:
        yield start, texts


def count_hashes(docs: DataFrame) -> DataFrame:
    """word (hash as long), n over all texts; word 0 counts the texts with words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            for _, texts in _chunks(batch, "text"):
                words, n = np.unique(hashes.bigrams(texts)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _target_counts(docs: DataFrame, marks: DataFrame, hot: np.ndarray) -> tuple[float, np.ndarray]:
    """Bigrams of the target texts, and how many of them end in each of the words `hot` (sorted)."""
    def per_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            for start, texts in _chunks(batch, "__text"):
                _, words, n = hashes.bigrams(texts)
                place = np.searchsorted(hot, words)
                here = hot[np.minimum(place, len(hot) - 1)] == words if len(hot) else np.zeros(len(words), bool)
                ends = np.cumsum(n)
                lists = [place[i:j][here[i:j]].astype(np.uint32).tobytes() for i, j in zip(ends - n, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(texts)), pa.array(n), pa.array(lists, pa.binary())], ["doc_id", "n", "hot"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(hot) + 1, np.int64)
        for batch in batches:
            places = np.frombuffer(b"".join(batch.column("hot").to_pylist()), np.uint32)
            sums[:-1] += np.bincount(places, minlength=len(hot))
            sums[-1] += batch.column("n").to_numpy().sum()
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["at", "n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.select("doc_id", docs["text"].alias("__text")).mapInArrow(per_text, f"doc_id {kind}, n long, hot binary")
    found = counted.join(marks.hint("merge"), "doc_id").select("n", "hot").mapInArrow(total, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(len(hot) + 1)
    sums[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return float(sums[-1]), sums[:-1]


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys starts."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def _pack(first: np.ndarray, second: np.ndarray, text: np.ndarray, n: np.ndarray, mine: np.ndarray) -> bytes:
    """Bigrams of texts, in order of second word, first word and text, as one string of bytes. `mine` marks target rows."""
    pairs = _starts(second, first)
    words = _starts(second[pairs])
    per_pair = np.diff(np.append(pairs, len(text))).astype(np.uint32)
    per_word = np.diff(np.append(words, len(pairs))).astype(np.uint32)
    sizes = np.array([len(words), len(pairs), len(text)], np.uint32)
    steps = np.diff(text, prepend=np.uint16(0)).astype(np.uint16)  # modulo 2^16
    parts = (sizes, second[pairs][words], per_word, first[pairs], per_pair, steps, n.astype(np.uint32), np.packbits(mine))
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in parts))


def _unpack(payload: bytes) -> tuple[np.ndarray, ...]:
    """First and second word of each bigram, and bigram number, text, n and target mark of each row."""
    raw = zstandard.ZstdDecompressor().decompress(payload)
    words, pairs, rows = (int(x) for x in np.frombuffer(raw, np.uint32, 3))
    at, out = 12, []
    for kind, size in ((np.uint64, words), (np.uint32, words), (np.uint64, pairs), (np.uint32, pairs), (np.uint16, rows), (np.uint32, rows), (np.uint8, -(-rows // 8))):
        out.append(np.frombuffer(raw, kind, size, at))
        at += out[-1].nbytes
    word, per_word, first, per_pair, steps, n, bits = out
    text = np.cumsum(steps, dtype=np.uint16)
    return first, np.repeat(word, per_word), np.repeat(np.arange(pairs), per_pair), text, n, np.unpackbits(bits, count=rows).astype(bool)


_PART = np.dtype([("text", np.uint16), ("target", np.float32), ("background", np.float32)])
_PACKED = "chunk long, bucket int, head boolean, payload binary"


def _spread(texts: DataFrame, columns: list[str], hot: np.ndarray, buckets: int) -> DataFrame:
    """The texts in chunks: for each a head (its rows without the text) and a packed list for each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, chunk = Hashes(), TaskContext.get().partitionId() << 33
        for batch in batches:
            for start, values in _chunks(batch, "__text"):
                first, second, n = hashes.bigrams(values)
                rows = pa.Table.from_batches([batch.slice(start, len(values))])
                head = rows.select(columns).append_column("__n", pa.array(n))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, head.schema) as writer:
                    writer.write_table(head)
                marks = np.array([bool(m) for m in rows.column("__target").to_pylist()], bool)
                text = np.repeat(np.arange(len(values)), n).astype(np.uint16)
                key = second
                if len(hot):
                    spots = np.minimum(np.searchsorted(hot, second), len(hot) - 1)
                    key = np.where(hot[spots] == second, second ^ (first * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(7)), second)
                bucket = (key % np.uint64(buckets)).astype(np.int32)
                order = np.lexsort((text, first, second, bucket))
                first, second, text, bucket = first[order], second[order], text[order], bucket[order]
                at = _starts(bucket, second, first, text) if len(text) else np.empty(0, np.int64)
                times = np.diff(np.append(at, len(text)))
                first, second, text, bucket = first[at], second[at], text[at], bucket[at]
                cuts = _starts(bucket) if len(bucket) else at
                spans = list(zip(cuts, [*cuts[1:], len(at)], strict=True))
                payloads = [sink.getvalue().to_pybytes()] + [_pack(first[i:j], second[i:j], text[i:j], times[i:j], marks[text[i:j]]) for i, j in spans]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(payloads), chunk, np.int64)), pa.array([chunk % buckets, *bucket[cuts].tolist()], pa.int32()),
                        pa.array([True] + [False] * len(spans)), pa.array(payloads, pa.binary()),
                    ],
                    ["chunk", "bucket", "head", "payload"],
                )
                chunk += 1

    return texts.mapInArrow(run, _PACKED)


def score_corpus(docs: DataFrame, targets: DataFrame, columns: list[str], bucket_tokens: int = BUCKET_TOKENS, prior: float = PRIOR) -> DataFrame:
    """The named columns with n_tokens, target_loss, background_loss (nats per token) and score, their difference.

    The models are learned from all of `docs`; `targets` holds the doc_ids of the target texts. A higher score means closer
    to the target. A null or blank text has no tokens, null losses and score 0. Without target words both models are the
    background's, so every score is 0.
    """
    columns = list(columns)
    marks = targets.where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    counted = materialize(count_hashes(docs), "words")
    size, of_all = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
    of_all = float(of_all or 0)
    # at most four for each bucket
    found = counted.where(F.col("n") > bucket_tokens / 4).select("word", "n").toArrow()
    hot, hot_all = found.column("word").to_numpy().astype(np.int64).view(np.uint64), found.column("n").to_numpy().astype(np.float64)
    order = np.argsort(hot)
    hot, hot_all = hot[order], hot_all[order]
    of_target, hot_target = _target_counts(docs, marks, hot)
    scale = of_target / of_all if of_target else 1.0
    mass = (of_target or of_all) + 0.5 * size

    def loss(bigram: np.ndarray, word: np.ndarray) -> np.ndarray:
        return np.log(word + prior) - np.log(bigram + prior * (word + 0.5) / mass)

    def judge(table: pa.Table) -> pa.Table:
        heads = table.filter(table["head"]).select(["chunk", "head", "payload"])
        lists = table.filter(pa.compute.invert(table["head"]))
        chunks, packed = lists["chunk"].to_pylist(), lists["payload"]
        seconds, firsts, sums = [], [], []
        for p in packed:
            first, second, pair, _, n, mine = _unpack(p.as_py())
            seconds.append(second)
            firsts.append(first)
            sums.append(np.stack([np.bincount(pair, n * mine, len(first)), np.bincount(pair, n, len(first))]))
        if not chunks:
            return heads
        second, first, counts = np.concatenate(seconds), np.concatenate(firsts), np.concatenate(sums, axis=1)
        order = np.lexsort((first, second))
        at = _starts(second[order], first[order])
        group = np.empty(len(order), np.int64)
        group[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(order))))
        counts = np.add.reduceat(counts[:, order], at, axis=1)
        second = second[order][at]
        runs = _starts(second)
        words = np.add.reduceat(counts, runs, axis=1)
        if len(hot):
            spots = np.minimum(np.searchsorted(hot, second[runs]), len(hot) - 1)
            known = hot[spots] == second[runs]
            words[:, known] = np.stack([hot_target, hot_all])[:, spots[known]]
        words = np.repeat(words, np.diff(np.append(runs, len(second))), axis=1)
        background = loss(counts[1] * scale, words[1] * scale)
        target = loss(counts[0], words[0]) if of_target else background
        out, begin = [], 0
        for p, firsts_here in zip(packed, firsts, strict=True):
            _, _, pair, text, n, _ = _unpack(p.as_py())
            mine = group[begin:begin + len(firsts_here)][pair]
            begin += len(firsts_here)
            texts, back = np.unique(text, return_inverse=True)
            part = np.empty(len(texts), _PART)
            part["text"], part["target"], part["background"] = texts, np.bincount(back, n * target[mine]), np.bincount(back, n * background[mine])
            out.append(part.tobytes())
        told = pa.table({"chunk": pa.array(chunks, pa.int64()), "head": pa.array([False] * len(out)), "payload": pa.array(out, pa.binary())})
        return pa.concat_tables([heads.cast(told.schema), told])

    def total(table: pa.Table) -> pa.Table:
        head = table.filter(table["head"])["payload"][0].as_py()
        rows = pa.ipc.open_stream(head).read_all()
        n = rows.column("__n").to_numpy()
        parts = np.frombuffer(b"".join(table.filter(pa.compute.invert(table["head"]))["payload"].to_pylist()), _PART)
        target, background = (np.bincount(parts["text"], parts[c].astype(np.float64), len(n)) / np.maximum(n, 1) for c in ("target", "background"))
        blank = n == 0
        out = rows.select(columns).append_column("n_tokens", pa.array(np.maximum(n - 1, 0)))
        out = out.append_column("target_loss", pa.array(target, mask=blank))
        out = out.append_column("background_loss", pa.array(background, mask=blank))
        return out.append_column("score", pa.array(np.where(blank, 0.0, background - target)))

    given = docs.select(*columns, docs["doc_id"].alias("__id"), _shrunk(docs["text"]).alias("__text"))
    # labels grow with the documents, so the join shuffles both sides at any size
    known = marks.select(F.col("doc_id").alias("__id"), F.lit(True).alias("__target")).hint("merge")
    texts = given.join(known, "__id", "left").select(*columns, "__text", "__target")
    spread = _spread(texts, columns, hot, max(1, int(-(-of_all // bucket_tokens))))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*columns).schema)
    judged = spread.groupBy("bucket").applyInArrow(judge, "chunk long, head boolean, payload binary")
    return judged.groupBy("chunk").applyInArrow(total, f"{kept}n_tokens long, target_loss double, background_loss double, score double")
