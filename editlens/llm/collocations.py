"""Phrase collocations from FM-indexes of shards.

A shard is some million consecutive words of a scan partition as numbers, with a break between pieces of text. Its index is
bidirectional: the Burrows-Wheeler transforms of the sequence and of its reverse, both sorted by as many symbols as the
longest phrase has words, which is all that intervals of phrases of that length need. All intervals of a depth are extended
by a word at once. Counts of a phrase are summed across shards by Spark.

The walk goes down together in all shards, so that rare phrases are left early and exactly: words with too few occurrences in
the whole table start no interval, and phrases of three words come only from extending phrases of two that are frequent
themselves. What is frequent returns to the shards that hold it by a join on the shard's number, never by a broadcast.

Texts count per language, a null language as `und`; a null text is empty. Repeated rows count each time. Words may be of
any length. An empty table has no phrases.
"""

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from editlens.session import materialize

SHARD_WORDS = 2_000_000
LEAST_COUNT = 10
TOP = 2000
NO_LANG = "und"
#: Marks and line ends that no phrase crosses; each becomes a line end, and a tab a space.
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_TO_BLANKS = bytes.maketrans(BREAKS + b"\t", b"\n" * len(BREAKS) + b" ")
#: Phrases of two words are held as one long.
MAX_WORDS = 1 << 31


class FMIndex:
    """Burrows-Wheeler transform of a cyclic sequence of numbers, rows sorted by their first `depth` symbols.

    0 is the break. Equal rows stand in the order of their places, which keeps the last-to-first mapping right.
    """

    def __init__(self, sequence: np.ndarray, n_symbols: int, depth: int):
        keys = [np.roll(sequence, -i) for i in range(depth)]
        if n_symbols ** depth < 1 << 63:
            packed = keys[0].astype(np.int64)
            for k in keys[1:]:
                packed = packed * n_symbols + k
            rows = np.argsort(packed, kind="stable")
        else:
            rows = np.lexsort(keys[::-1])
        self.bwt = sequence[rows - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=n_symbols))])
        self.by_symbol = np.argsort(self.bwt, kind="stable")  # row j of this order is what last-to-first maps to row j

    def extend(self, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All words in front of disjoint intervals: interval, symbol (the break too), first row and size of each extension."""
        interval_of = np.full(len(self.bwt), -1, np.int32)
        ends = np.cumsum(size)
        rows = np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - size), size)
        interval_of[rows] = np.repeat(np.arange(len(low), dtype=np.int32), size)
        parent, symbol = interval_of[self.by_symbol], self.bwt[self.by_symbol]
        used = np.flatnonzero(parent >= 0)
        parent, symbol = parent[used], symbol[used]
        new = np.flatnonzero(np.r_[True, (parent[1:] != parent[:-1]) | (symbol[1:] != symbol[:-1])]) if len(used) else used
        return parent[new], symbol[new], used[new], np.diff(np.r_[new, len(used)])


class ShardIndex:
    """Both directions of a shard. An interval has its first row in either and one size."""

    def __init__(self, sequence: np.ndarray, depth: int):
        n = int(sequence.max(initial=0)) + 1
        self.forward, self.backward = FMIndex(sequence, n, depth), FMIndex(sequence[::-1].copy(), n, depth)

    def words(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low = self.forward.first[wanted]
        return low, low, self.forward.first[wanted + 1] - low

    @staticmethod
    def _extend(index: FMIndex, low: np.ndarray, other: np.ndarray, size: np.ndarray):
        parent, symbol, new_low, new_size = index.extend(low, size)
        # The other direction's interval is cut into the extensions in the order of their symbols, the break first.
        order = np.lexsort([symbol, parent])
        before = np.cumsum(new_size[order]) - new_size[order]
        opens = np.flatnonzero(np.r_[True, np.diff(parent[order]) != 0]) if len(order) else order
        inside = before - np.repeat(before[opens], np.diff(np.r_[opens, len(order)]))
        new_other = np.empty_like(new_low)
        new_other[order] = other[parent[order]] + inside
        word = symbol != 0
        return parent[word], symbol[word], new_low[word], new_other[word], new_size[word]

    def left(self, forward: np.ndarray, backward: np.ndarray, size: np.ndarray):
        """Interval, word in front, both first rows and size of every left extension."""
        return self._extend(self.forward, forward, backward, size)

    def right(self, forward: np.ndarray, backward: np.ndarray, size: np.ndarray):
        """Interval, word behind, both first rows and size of every right extension."""
        parent, symbol, back, front, new_size = self._extend(self.backward, backward, forward, size)
        return parent, symbol, front, back, new_size


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers as four planes of bytes, of which the upper ones compress to nothing."""
    return np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


SHARD_SCHEMA = "shard long, lang string, word string, local int, n long, tokens binary"
_SHARD_ARROW = pa.schema([
    ("shard", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("local", pa.int32()), ("n", pa.int64()),
    ("tokens", pa.binary()),
])


class _Shard:
    """Numbers the words of texts as they come; 0 is the break."""

    def __init__(self):
        number = count(1).__next__
        self.known: dict[str, defaultdict[bytes, int]] = defaultdict(lambda: self._numbers(number))
        self.parts, self.size = [np.zeros(1, np.int32)], 1

    @staticmethod
    def _numbers(number) -> defaultdict[bytes, int]:
        words = defaultdict(number)
        words[b"\n"], words[b""] = 0, -1
        return words

    def add(self, lang: str, text: str) -> None:
        raw = text.encode().lower().translate(_TO_BLANKS).replace(b"\n", b" \n ").split(b" ")
        numbers = np.fromiter(map(self.known[lang].__getitem__, raw), np.int32, len(raw))
        numbers = np.append(numbers[numbers >= 0], np.int32(0))
        keep = numbers != 0
        keep[1:] |= numbers[:-1] != 0  # one break between pieces is enough
        self.parts.append(numbers[keep])
        self.size += len(self.parts[-1])

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        sequence = np.concatenate(self.parts)
        n = np.bincount(sequence)
        for lang, words in self.known.items():
            found = [(w, i) for w, i in words.items() if i > 0]
            for at in range(0, len(found), 100_000):
                part = found[at:at + 100_000]
                local = np.fromiter((i for _, i in part), np.int32, len(part))
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([shard] * len(part), pa.int64()), "lang": pa.array([lang] * len(part), pa.string()),
                    "word": pa.array([w for w, _ in part], pa.binary()).cast(pa.string()), "local": pa.array(local),
                    "n": pa.array(n[local], pa.int64()), "tokens": pa.nulls(len(part), pa.binary()),
                }, _SHARD_ARROW)
        yield pa.RecordBatch.from_pylist([{"shard": shard, "tokens": _planes(sequence)}], _SHARD_ARROW)


def shards(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """A row per shard and word (lang, word, its number in the shard, occurrences), and one with the shard's sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 33, _Shard()
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                shard.add(NO_LANG if lang.as_py() is None else lang.as_py(), text.as_py() or "")
                if shard.size >= shard_words:
                    yield from shard.rows(number)
                    number, shard = number + 1, _Shard()
        if shard.size > 1:
            yield from shard.rows(number)

    return docs.select("lang", "text").mapInArrow(run, SHARD_SCHEMA)


def _relabel(tokens: bytes, local: np.ndarray) -> np.ndarray:
    """The sequence with the wanted words numbered from 1 in the order of `local`; all others become breaks."""
    sequence = _from_planes(tokens)
    rank = np.zeros(int(sequence.max(initial=0)) + 1, np.int32)
    rank[local] = np.arange(1, len(local) + 1, dtype=np.int32)
    return rank[sequence]


def _pairs_of_shard(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Counts of the phrases of two frequent words in a shard."""
    ids = right.column("id").to_numpy()
    sequence = _relabel(left.column("tokens")[0].as_py(), right.column("local").to_numpy())
    index = FMIndex(sequence, len(ids) + 1, 2)
    words = np.arange(1, len(ids) + 1)
    low = index.first[words]
    second, first, _, n = index.extend(low, index.first[words + 1] - low)
    word = first > 0
    pair = ids[first[word] - 1] << 32 | ids[second[word]]
    shard = np.full(len(pair), key[0].as_py(), np.int64)
    return pa.table({"pair": pa.array(pair), "shard": pa.array(shard), "n": pa.array(n[word].astype(np.int32))})


def _triples_of_shard(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Counts of the phrases of three words whose first two and last two are frequent pairs."""
    is_word = right.column("pair").is_null().to_numpy()
    ids = right.column("id").to_numpy(zero_copy_only=False)[is_word].astype(np.int64)
    local = right.column("local").to_numpy(zero_copy_only=False)[is_word].astype(np.int64)
    pairs = np.sort(right.column("pair").to_numpy(zero_copy_only=False)[~is_word].astype(np.int64))
    index = ShardIndex(_relabel(left.column("tokens")[0].as_py(), local), 3)

    def frequent(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        wanted = ids[first - 1] << 32 | ids[second - 1]
        at = np.minimum(np.searchsorted(pairs, wanted), len(pairs) - 1)
        return pairs[at] == wanted

    words = np.arange(1, len(ids) + 1)
    parent, first, forward, backward, size = index.left(*index.words(words))
    second = words[parent]
    alive = frequent(first, second)
    first, second, forward, backward, size = (v[alive] for v in (first, second, forward, backward, size))
    order = np.argsort(backward)  # intervals in the order of rows
    first, second, forward, backward, size = (v[order] for v in (first, second, forward, backward, size))
    parent, third, _, _, n = index.right(forward, backward, size)
    alive = frequent(second[parent], third)
    parent, third, n = parent[alive], third[alive], n[alive]
    pair = ids[first[parent] - 1] << 32 | ids[second[parent] - 1]
    return pa.table({"pair": pa.array(pair), "third": pa.array(ids[third - 1]), "n": pa.array(n.astype(np.int64))})


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """A written table with dense numbers `id` from 0: places in the parts of the table, and the parts' offsets."""
    written = materialize(df.withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftright("__at", 33)
    sizes = written.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))  # one row per task that wrote
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    number = F.col("__off") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    safe = F.when(number < MAX_WORDS, number).otherwise(F.raise_error(F.lit("too many frequent words")).cast("long"))
    return written.withColumn("__p", part).join(F.broadcast(offsets), "__p").withColumn("id", safe).drop("__p", "__at", "__off")


def phrase_counts(
    docs: DataFrame, least: int = LEAST_COUNT, shard_words: int = SHARD_WORDS
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Written tables: words of each lang (`lang`, `n`), and what occurs at least so often: words (`id`, `lang`, `word`, `f`),
    phrases of two (`pair`, `f`) and of three words (`pair`, `third`, `f`). A pair holds the ids of its words, high and low."""
    cut = materialize(shards(docs, shard_words), "shards")
    words = cut.where(F.col("tokens").isNull()).drop("tokens")
    sequences = cut.where(F.col("tokens").isNotNull()).select("shard", "tokens")
    counts = materialize(words.groupBy("lang", "word").agg(F.sum("n").alias("f")), "words")
    totals = materialize(counts.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    frequent = materialize(_numbered(counts.where(F.col("f") >= least), "frequent-words"), "numbered-words")
    places = materialize(
        words.join(frequent.select("lang", "word", "id"), ["lang", "word"]).select("shard", "local", "id"), "places"
    )
    found = sequences.groupBy("shard").cogroup(places.groupBy("shard")).applyInArrow(
        _if_both(_pairs_of_shard, {"pair": pa.int64(), "shard": pa.int64(), "n": pa.int32()}), "pair long, shard long, n int"
    )
    summed = found.withColumn("f", F.sum("n").over(Window.partitionBy("pair")))
    kept = materialize(summed.where(F.col("f") >= least).select("pair", "shard", "f"), "pairs-of-shards")
    pairs = materialize(kept.groupBy("pair").agg(F.first("f").alias("f")), "pairs")
    back = kept.select("shard", F.lit(None).cast("int").alias("local"), F.lit(None).cast("long").alias("id"), "pair")
    known = places.withColumn("pair", F.lit(None).cast("long")).unionByName(back)
    triples = sequences.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(
        _if_both(_triples_of_shard, {"pair": pa.int64(), "third": pa.int64(), "n": pa.int64()}), "pair long, third long, n long"
    )
    triples = triples.groupBy("pair", "third").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    return totals, frequent, pairs, materialize(triples, "triples")


def _if_both(function, kinds: dict[str, pa.DataType]):
    """No rows for a shard that has nothing frequent."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            return function(key, left, right)
        return pa.table({c: pa.array([], kind) for c, kind in kinds.items()})

    return run


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in whole numbers of 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right))


def _first_word(pair: str) -> Column:
    return F.shiftright(pair, 32)


def _second_word(pair: str) -> Column:
    return F.col(pair).bitwiseAND(F.lit(MAX_WORDS * 2 - 1))


def candidates(words: DataFrame, pairs: DataFrame, triples: DataFrame, contained_percent: int = 50) -> DataFrame:
    """Phrases with `lang`, `phrase`, `a`, `l`, `r` and `score` of the lowest cut, without those that a longer one explains.

    A phrase of two goes if one of its extensions by a word in front or behind has `contained_percent` of its count.
    """
    word = lambda n, *more: words.select(F.col("id").alias(f"w{n}"), F.col("word").alias(f"word{n}"), *more)
    f = lambda name: F.col("f").alias(name)
    longer = triples.select(
        F.explode(F.array("pair", F.shiftleft(_second_word("pair"), 32).bitwiseOR(F.col("third")))).alias("pair"), "f"
    ).groupBy("pair").agg(F.max("f").alias("longer"))
    two = (
        pairs.join(longer, "pair", "left").where(F.coalesce(100 * F.col("longer") < contained_percent * F.col("f"), F.lit(True)))
        .select(f("a"), _first_word("pair").alias("w1"), _second_word("pair").alias("w2"))
        .join(word(1, "lang", f("l")), "w1").join(word(2, f("r")), "w2")
        .select("lang", F.concat_ws(" ", "word1", "word2").alias("phrase"), "a", "l", "r", _score(F.col("a"), F.col("l"), F.col("r")).alias("score"))
    )
    rear = F.shiftleft(_second_word("pair"), 32).bitwiseOR(F.col("third"))
    three = (
        triples.select(
            f("a"), "pair", rear.alias("rear"), _first_word("pair").alias("w1"), _second_word("pair").alias("w2"),
            F.col("third").alias("w3"),
        )
        .join(pairs.select("pair", f("f12")), "pair").join(pairs.select(F.col("pair").alias("rear"), f("f23")), "rear")
        .join(word(1, "lang", f("f1")), "w1").join(word(2), "w2").join(word(3, f("f3")), "w3")
        .withColumns({"s1": _score(F.col("a"), F.col("f1"), F.col("f23")), "s2": _score(F.col("a"), F.col("f12"), F.col("f3"))})
    )
    early = F.col("s1") <= F.col("s2")
    three = three.select(
        "lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a", F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"),
        F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"),
    )
    return two.unionByName(three)


def collocations(
    docs: DataFrame, least: int = LEAST_COUNT, top: int = TOP, contained_percent: int = 50, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """The `top` phrases of two and three words of each lang: `lang`, `rank`, `phrase`, `a`, `l`, `r`, `n`, `score`.

    By score, then count, both falling, then phrase by its UTF-8 bytes.
    """
    totals, words, pairs, triples = phrase_counts(docs, least, shard_words)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = candidates(words, pairs, triples, contained_percent).withColumn("rank", F.row_number().over(best).cast("long"))
    return ranked.where(F.col("rank") <= top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
