"""Near-duplicates by a chosen-path set similarity join.

A document is the set of its five-word shingles; equal sets are joined first. Every set follows paths in independent
random trees: a node picks a few of the set's minwise tokens and each picked token leads to a child, so similar sets keep
meeting. Nodes of at most `SMALL` sets are compared exhaustively; larger ones first compare all members with a few of
them, then branch on. Sets that are known to be connected need no further comparison, which settles nodes full of near
copies; a node that one group fills but for a few sets is finished by comparing those few with all, in blocks. Candidates
pass an estimate from 256 minwise bytes. They travel as lists between blocks of 256 neighbouring sets, where they are
confirmed on the full sets, likeliest first; what is connected by then is not compared again.

Only node numbers, set numbers and sketches move; shingles of candidates alone are recomputed from their texts. Nothing is
collected: links and components stay tables.
"""

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from editlens.session import materialize

WORDS = 5
#: Least similarity of a link in percent: of the query by its contract, of a stage without one.
PERCENT, STAGE_PERCENT = 85, 80
MARKS, SKETCH = 64, 256
FAN, SMALL, PIVOTS = 2, 2048, 2
#: The share of pairs at the least similarity that the estimate and the trees may lose.
MISSED, LOST = 1e-6, 2e-6
BLOCK_BITS = 8
BROADCAST_IDS = 500_000
_MEMO = 500_000

_rng = np.random.default_rng(20240501)
_MUL = (_rng.integers(0, 1 << 31, SKETCH, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, SKETCH, dtype=np.uint32)
_PLACES = _rng.integers(1, 1 << 62, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROOTS = [int(p) for p in _rng.permutation(MARKS)]


def _binomial(n: int, p: float) -> list[float]:
    return [comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]


@lru_cache
def least_equal(percent: int) -> int:
    """A pair passes with so many of the 256 bytes equal; one at the least similarity has fewer once in a million."""
    share = percent / 100
    below = np.cumsum(_binomial(SKETCH, share + (1 - share) / 256))
    return int((below <= MISSED).sum())


@lru_cache
def trees(percent: int) -> int:
    """So many trees that all of them lose a pair at the least similarity about twice in a million.

    With a share f of the 64 tokens in common, a tree of two branches loses the pair at any depth with ((1 - f) / f)².
    """
    many = _binomial(MARKS, percent / 100)
    lost = [1.0 if 2 * k <= MARKS else ((MARKS - k) / k) ** 2 for k in range(MARKS + 1)]
    return next((n for n in range(1, MARKS // FAN) if sum(m * q**n for m, q in zip(many, lost, strict=True)) <= LOST), MARKS // FAN)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _MEMO:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, hashes: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; of its whole sequence if it has fewer words than one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - WORDS + 1)
    total = np.full(n, min(len(h), WORDS), np.uint64)
    for k in range(min(WORDS, len(h))):
        total += _mix(h[k:k + n] * _PLACES[k])
    return np.unique(_mix(total))


def minwise(hashes: np.ndarray) -> np.ndarray:
    """256 minwise tokens of a set, over blocks of the set so that memory stays bounded."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(low), 2048):
        np.minimum(out, (low[start:start + 2048, None] * _MUL + _ADD).min(axis=0), out=out)
    return out


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, key (of the set; null if empty), marks (64 tokens of 4 bytes) and sketch (256 bytes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            n, keys, marks, sketches = [], [], [], []
            for text in batch.column("text"):
                found = shingles(text.as_py(), hashes)
                n.append(len(found))
                if not len(found):
                    keys.append(None)
                    marks.append(None)
                    sketches.append(None)
                    continue
                tokens = minwise(found)
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                marks.append(tokens[:MARKS].astype(">u4").tobytes())
                sketches.append((tokens >> np.uint32(7)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), *[pa.array(x, pa.binary()) for x in (keys, marks, sketches)]],
                ["doc_id", "n_shingles", "key", "marks", "sketch"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, key binary, marks binary, sketch binary")


def distinct_sets(described: DataFrame) -> DataFrame:
    """One row per set: sid, key, n, marks, sketch and its smallest doc_id. Neighbours in sid order have alike marks."""
    sets = described.where(F.col("key").isNotNull()).groupBy("key").agg(
        F.first("n_shingles").alias("n"), F.first("marks").alias("marks"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("first_id")
    )
    ordered = sets.repartitionByRange("marks").sortWithinPartitions("marks")
    return materialize(ordered.withColumn("sid", F.monotonically_increasing_id()), "sets")


def _token(at: Column) -> Column:
    return F.substring(F.col("marks"), at * 4 + 1, F.lit(4))


def _roots(sets: DataFrame, percent: int) -> DataFrame:
    first = [F.xxhash64(F.lit(i // FAN), F.lit(p), _token(F.lit(p))) for i, p in enumerate(_ROOTS[: trees(percent) * FAN])]
    return sets.select(F.explode(F.array(*first)).alias("node"), "sid")


def _children(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """The next level: a node's number picks two of the 64 tokens for all its members."""
    one = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(MARKS)).cast("int")
    two = F.pmod(one + 1 + F.pmod(F.xxhash64("node", F.lit(2)), F.lit(MARKS - 1)).cast("int"), F.lit(MARKS))
    child = lambda at: F.xxhash64("node", at, _token(at))
    return rows.select("node", "sid").join(sets.select("sid", "marks"), "sid").select(
        F.explode(F.array(child(one), child(two))).alias("node"), "sid"
    )


def _shared(rows: DataFrame) -> DataFrame:
    """Rows of nodes with two sets or more, with their count."""
    sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n_sets")).where("n_sets > 1")
    return rows.join(sizes, "node")


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("label", F.col("sid"))
    return rows.join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))


def _equal(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Equal bytes of the sketches; 0 where the sizes alone rule a link out."""
    sizes = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    return np.where(sizes, (a == b).sum(axis=-1), 0)


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SKETCH)


def _likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that pass the estimate, as lists between blocks."""
    least = least_equal(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b, n_a, n_b = (batch.column(c).to_numpy() for c in ("a", "b", "n_a", "n_b"))
                equal = _equal(_sketches(batch.column("sketch_a")), _sketches(batch.column("sketch_b")), n_a, n_b, percent)
                good = equal >= least
                if good.any():
                    yield _lists(a[good], b[good], equal[good])

    of = lambda s: sets.select(F.col("sid").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    sized = F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    return pairs.join(of("a"), "a").join(of("b"), "b").where(sized).mapInArrow(run, _LISTS)


_LISTS = "ga long, gb long, pairs binary, sids array<long>"
_PAIR = np.dtype([("a", np.uint8), ("b", np.uint8), ("miss", np.uint16)])


def _lists(a: np.ndarray, b: np.ndarray, equal: np.ndarray) -> pa.RecordBatch:
    """Pairs of set numbers (one at least) as one list for each pair of blocks: places in the blocks, how many bytes differ, and the sets."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    ga, gb = low >> BLOCK_BITS, high >> BLOCK_BITS
    order = np.lexsort((gb, ga))
    ga, gb = ga[order], gb[order]
    pairs = np.empty(len(order), _PAIR)
    mask = (1 << BLOCK_BITS) - 1
    pairs["a"], pairs["b"], pairs["miss"] = low[order] & mask, high[order] & mask, SKETCH - equal[order]
    low, high = low[order], high[order]
    starts = np.flatnonzero(np.concatenate([[True], (ga[1:] != ga[:-1]) | (gb[1:] != gb[:-1])]))
    spans = list(zip(starts, [*starts[1:], len(order)], strict=True))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ga[starts]), pa.array(gb[starts]), pa.array([pairs[i:j].tobytes() for i, j in spans], pa.binary()),
            pa.array([np.unique(np.concatenate([low[i:j], high[i:j]])) for i, j in spans], pa.list_(pa.int64())),
        ],
        ["ga", "gb", "pairs", "sids"],
    )


def _star_pairs(large: DataFrame) -> DataFrame:
    """Every member of a large node with a few members chosen by hash, unless already connected."""
    picks = [F.min(F.struct(F.xxhash64("sid", F.lit(k)).alias("h"), F.col("sid"), F.col("label"))).alias(f"p{k}") for k in range(PIVOTS)]
    pivots = large.groupBy("node").agg(*picks).select("node", F.explode(F.array_distinct(F.array(
        *[F.struct(F.col(f"p{k}.sid").alias("pivot"), F.col(f"p{k}.label").alias("pivot_label")) for k in range(PIVOTS)]
    ))).alias("p")).select("node", "p.*")
    met = large.join(pivots, "node").where("sid <> pivot AND label <> pivot_label")
    return met.select(F.least("sid", "pivot").alias("a"), F.greatest("sid", "pivot").alias("b")).distinct()


def _exhaustive(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Likely pairs of differently labelled sets in small nodes, and of the few with all in nodes that one group fills.

    `mixed` has node, sid, label, few (not of the filling group) and n_sets. Large nodes are cut into blocks of the
    filling group, each with all of the few, so a compared block has at most twice `SMALL` sets.
    """
    least = least_equal(percent)
    blocks = F.when(F.col("n_sets") <= SMALL, 1).otherwise(F.ceil(F.col("n_sets") / SMALL)).cast("int")
    own = F.when(blocks == 1, F.array(F.lit(0))).when(
        F.col("few"), F.sequence(F.lit(0), blocks - 1)
    ).otherwise(F.array(F.pmod(F.xxhash64("sid"), blocks).cast("int")))
    placed = mixed.select("node", F.explode(own).alias("block"), "sid", "label", "few").join(sets.select("sid", "n", "sketch"), "sid")
    grouped = placed.groupBy("node", "block").agg(F.collect_list(F.struct("sid", "label", "few", "n", "sketch")).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                members = batch.column("m")[k].values
                sid, label, few, n = (members.field(f).to_numpy(zero_copy_only=False) for f in ("sid", "label", "few", "n"))
                sketch = _sketches(members.field("sketch"))
                found = []
                for i in np.flatnonzero(few):
                    others = np.flatnonzero((label != label[i]) & (~few | (np.arange(len(sid)) > i)))
                    equal = _equal(sketch[others], sketch[i], n[others], n[i], percent)
                    good = equal >= least
                    if good.any():
                        found.append((np.full(good.sum(), sid[i]), sid[others[good]], equal[good]))
                if found:
                    yield _lists(*(np.concatenate(x) for x in zip(*found, strict=True)))

    return grouped.where(F.size("m") > 1).select("m").mapInArrow(run, _LISTS)


class _Confirm:
    """Confirms pairs on full sets. Shingles of a set are computed from its text once and kept as a table."""

    def __init__(self, docs: DataFrame, sets: DataFrame, percent: int):
        self.docs, self.sets, self.known, self.percent = docs.select("doc_id", "text"), sets, None, percent

    def _fetch(self, sids: DataFrame) -> None:
        new = sids if self.known is None else sids.join(self.known.select("sid"), "sid", "left_anti")
        wanted = materialize(new.join(self.sets.select("sid", "key", "first_id"), "sid"), "wanted")
        ids = materialize(wanted.select(F.col("first_id").alias("doc_id")).distinct(), "wanted-ids")
        count = ids.count()
        if count == 0:
            return

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = _WordHashes()
            for batch in batches:
                found = [shingles(t.as_py(), hashes).tobytes() for t in batch.column("text")]
                keys = [hashlib.blake2b(f, digest_size=16).digest() for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.binary())], ["key", "shingles"])

        side = F.broadcast(ids) if count <= BROADCAST_IDS else ids  # ids of 8 bytes, counted from the written table
        side = side.withColumnRenamed("doc_id", "__id")
        texts = self.docs.join(side, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select("text")
        found = texts.mapInArrow(run, "key binary, shingles binary").join(wanted.select("sid", "key"), "key")
        found = materialize(found.groupBy("sid").agg(F.first("shingles").alias("shingles")), "shingles")
        self.known = found if self.known is None else self.known.unionByName(found)

    def __call__(self, lists: DataFrame, labels: DataFrame | None) -> DataFrame | None:
        """Links (a, b) that connect what the confirmed pairs connect; None if there are no pairs at all.

        Within two blocks, pairs are looked at from the likeliest on; one whose sets are connected by then is left out.
        """
        lists = materialize(lists, "lists")
        if lists.isEmpty():
            return None
        met = lists.groupBy(F.col("ga").alias("ha"), F.col("gb").alias("hb")).agg(F.array_distinct(F.flatten(F.collect_list("sids"))).alias("sids"))
        named = met.select("ha", "hb", F.explode("sids").alias("sid"))  # at most two blocks of sets
        named = materialize(_labelled(named, labels), "named")
        self._fetch(named.select("sid").distinct())
        members, percent = named.join(self.known, "sid"), self.percent

        def compare(left: pa.Table, right: pa.Table) -> pa.Table:
            sids = right["sid"].to_pylist()
            sets = {s: np.frombuffer(h, np.uint64) for s, h in zip(sids, right["shingles"].to_pylist(), strict=True)}
            of = dict(zip(sids, right["label"].to_pylist(), strict=True))
            parent = {label: label for label in of.values()}

            def root(s: int) -> int:
                at = of[s]
                while parent[at] != at:
                    parent[at] = at = parent[parent[at]]
                return at

            pairs = np.unique(np.frombuffer(b"".join(left["pairs"].to_pylist()), _PAIR))
            ga, gb = (left[c][0].as_py() << BLOCK_BITS for c in ("ga", "gb"))
            linked = []
            for a, b, _ in pairs[np.argsort(pairs["miss"], kind="stable")].tolist():
                x, y = ga + a, gb + b
                if (at := root(x)) == (to := root(y)):
                    continue
                p, q = sets[x], sets[y]
                if len(p) > len(q):
                    p, q = q, p
                spots = np.searchsorted(q, p)
                spots[spots == len(q)] = 0
                both = int((q[spots] == p).sum())
                if 100 * both >= percent * (len(p) + len(q) - both):
                    parent[at] = to
                    linked.append((x, y))
            return pa.table({k: pa.array([x[i] for x in linked], pa.int64()) for i, k in enumerate("ab")})

        found = lists.select("ga", "gb", "pairs").groupBy("ga", "gb").cogroup(members.groupBy("ha", "hb")).applyInArrow(compare, "a long, b long")
        return materialize(found, "links")


def components(links: DataFrame) -> DataFrame:
    """sid, label: the smallest set number that the links (a, b) reach. Every round halves the longest way, about."""
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("sid"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("sid").alias("b"), F.col("label").alias("l")), "b").groupBy(F.col("a").alias("sid")).agg(F.min("l").alias("l"))
        lower = labels.join(near, "sid").select("sid", "label", F.least("label", "l").alias("next"))
        far = labels.select(F.col("sid").alias("next"), F.col("label").alias("far"))
        new = materialize(lower.join(far, "next").select("sid", F.least("next", "far").alias("label"), (F.least("next", "far") < F.col("label")).alias("moved")), "labels")
        labels = new.select("sid", "label")
        if new.where("moved").isEmpty():
            return labels


def link_sets(docs: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Component labels of all linked sets (sid, label); None if no two different sets are linked."""
    confirm, links, labels = _Confirm(docs, sets, percent), None, None

    def take(pairs: DataFrame) -> None:
        nonlocal links, labels
        new = confirm(pairs, labels)
        if new is not None and not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            labels = components(links)

    rows = materialize(_shared(_roots(sets, percent)), "nodes")
    while not rows.isEmpty():
        large = rows.where(F.col("n_sets") > SMALL)
        if not large.isEmpty():
            take(_likely(_star_pairs(_labelled(large, labels)), sets, percent))
        labelled = materialize(_labelled(rows, labels), "labelled")
        parts = labelled.groupBy("node", "label").agg(F.count(F.lit(1)).alias("c"))
        kinds = parts.groupBy("node").agg(F.max(F.struct("c", "label")).alias("top")).select("node", F.col("top.c").alias("most"), F.col("top.label").alias("filling"))
        mixed = labelled.join(kinds.where("most > 0"), "node").where("most < n_sets")
        is_small = F.col("n_sets") <= SMALL
        done = is_small | (F.col("n_sets") - F.col("most") <= SMALL)
        few = is_small | (F.col("label") != F.col("filling"))
        take(_exhaustive(mixed.where(done).withColumn("few", few), sets, percent))
        rows = materialize(_shared(_children(mixed.where(~done), sets)), "nodes")
    return labels


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document; links take a similarity of `percent` or more.

    Documents without words form no set and are linked with nothing. A null doc_id takes part; its group has the smallest
    id there is, or null. Rows that repeat an id and a text stand in one group and are all kept if they are its first.
    Other columns are not read. An empty table gives an empty result.
    """
    described = materialize(describe(docs), "described")
    sets = distinct_sets(described)
    labels = link_sets(docs, sets, percent)
    first = sets.select("key", "sid", "first_id")
    if labels is not None:
        named = first.join(labels, "sid")
        lowest = named.groupBy("label").agg(F.min("first_id").alias("lowest"))
        moved = named.join(lowest, "label").select("key", "lowest")
        first = first.join(moved, "key", "left").withColumn("first_id", F.coalesce("lowest", "first_id"))
    groups = first.select("key", F.col("first_id").alias("__group"))
    with_set = described.where("key IS NOT NULL").select("doc_id", "n_shingles", "key").join(groups, "key")
    alone = described.where("key IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("__group"))
    both = with_set.select("doc_id", "n_shingles", "__group").unionByName(alone)
    return both.select("doc_id", "n_shingles", F.col("__group").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("__group")).alias("kept"))


def without_near_duplicates(docs: DataFrame, percent: int = STAGE_PERCENT) -> DataFrame:
    """The rows of `docs` that are the first of their group, one row per group; without an id, equal texts count as one."""
    kept = near_duplicates(docs, percent).where("kept").select("doc_id").distinct().withColumnRenamed("doc_id", "__id")
    rows = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    same = Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text"))).orderBy("text")
    return rows.withColumn("__row", F.row_number().over(same)).where("__row = 1").drop("__row")
