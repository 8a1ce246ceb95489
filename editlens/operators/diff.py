"""Text difference of a revision and its parent: lines, sentences, changed pairs.

All steps of a revision work on the partition its texts were hashed to: one shuffle of the texts, then explode,
count and collect inside it. Texts that are equal are dropped before anything is exploded. What is left of a
revision, two lists of sentences, is written; lists too long for one call are compared in blocks by many tasks.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from editlens import schema as S
from editlens.functions.similarity import similar_pairs
from editlens.functions.text import split_lines, split_sentences
from editlens.session import materialize

PARENT_TEXT = "parent_text"
CURRENT_TEXT = "revision_text"
#: Sentence pairs one call compares; a revision with more is dealt out in blocks of so many sentences a side.
PAIRS_PER_CALL = 1_000_000
BLOCK = 1000
#: Characters of pairs that are held as Python's strings.
CHARS = 1_000_000
TIERS = (94, 88, 80, 70)


def line_set_diff(
    df: DataFrame, keys: Sequence[str] = S.KEYS, parent: str = PARENT_TEXT, current: str = CURRENT_TEXT,
    drop_empty: bool = False, partitions: int | None = None, dealt: bool = False,
) -> DataFrame:
    """Lines whose number of copies differs: `delta` > 0 for lines gained, < 0 for lines lost.

    `partitions` fixes the number of tasks, for jobs whose later steps cost more than their bytes tell. `dealt` says that the
    texts are dealt by the keys already, as in a bucketed table, and stay where they are.
    """
    changed = df.where(~F.col(parent).eqNullSafe(F.col(current))).select(*keys, parent, current)
    side = lambda text, weight: F.transform(
        split_lines(F.coalesce(F.col(text), F.lit(""))),
        lambda line: F.struct(line.alias("line"), F.lit(weight).alias("__w")),
    )
    hashed = changed if dealt else changed.repartition(*([partitions] if partitions else []), *keys)
    lines = hashed.select(*keys, F.inline(F.concat(side(current, 1), side(parent, -1))))
    if drop_empty:
        lines = lines.where(F.length("line") > 0)
    return lines.groupBy(*keys, "line").agg(F.sum("__w").alias("delta")).where(F.col("delta") != 0)


def sentence_sets(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct sentences of the lost and of the gained lines per revision, without those on both sides."""
    sentences = lines.select(
        *keys, (F.col("delta") > 0).alias("__new"), F.explode(split_sentences(F.col("line"))).alias("__s")
    )
    sets = sentences.groupBy(*keys).agg(
        F.collect_set(F.when(F.col("__new"), F.col("__s"))).alias("__added"),
        F.collect_set(F.when(~F.col("__new"), F.col("__s"))).alias("__deleted"),
    )
    return sets.select(
        *keys,
        F.array_sort(F.array_except("__added", "__deleted")).alias("added"),
        F.array_sort(F.array_except("__deleted", "__added")).alias("deleted"),
    )


def _free_pairs(old: np.ndarray, new: np.ndarray, used_old: set[int], used_new: set[int]) -> Iterator[int]:
    """Places of the pairs, best first, that are taken: both sentences are still free."""
    for at, (i, j) in enumerate(zip(old.tolist(), new.tolist(), strict=True)):
        if i not in used_old and j not in used_new:
            used_old.add(i)
            used_new.add(j)
            yield at


def _tiers(threshold: int) -> list[int]:
    """Thresholds from high to low. Pairs above one are all taken before any below, so each tier sees only what is still free,
    and a high threshold rules out nearly all pairs by their character counts."""
    return [*(t for t in TIERS if t > threshold), threshold]


def match_sentences(deleted: Sequence[str], added: Sequence[str], threshold: int) -> list[dict[str, str]]:
    """One-to-one pairs above the threshold, best ratio first, ties by deleted, then added text."""
    old, new, pairs = sorted(deleted), sorted(added), []
    for tier in _tiers(threshold):
        i, j, ratios = similar_pairs(old, new, tier)
        order = np.lexsort([j, i, -ratios])
        used_old, used_new = set(), set()
        i, j = i[order], j[order]
        pairs += [{"before": old[i[at]], "after": new[j[at]]} for at in _free_pairs(i, j, used_old, used_new)]
        old = [t for k, t in enumerate(old) if k not in used_old]
        new = [t for k, t in enumerate(new) if k not in used_new]
    return pairs


def _pair_lists(ends: list[int], pairs: list[dict[str, str]]) -> pa.Array:
    sides = [pa.array([p[name] for p in pairs], pa.string()) for name in ("before", "after")]
    return pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.StructArray.from_arrays(sides, ["before", "after"]))


def match_changed_sentences(deleted: Column, added: Column, threshold: int = S.SIMILARITY_THRESHOLD) -> Column:
    """Array of (before, after) pairs of similar sentences of one revision, in one call. Both arrays hold distinct sentences.

    Python holds the sentences of one revision at a time, and hands pairs on when there are many.
    """

    @F.arrow_udf(S.CHANGE_PAIRS)
    def matched(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for old, new in batches:
            ends, pairs, chars = [], [], 0
            for o, n in zip(old, new, strict=True):
                if o.is_valid and n.is_valid:
                    pairs += match_sentences(o.as_py(), n.as_py(), threshold)
                    chars += sum(len(p["before"]) + len(p["after"]) for p in pairs[ends[-1] if ends else 0:])
                ends.append(len(pairs))
                if chars > CHARS:
                    yield _pair_lists(ends, pairs)
                    ends, pairs, chars = [], [], 0
            yield _pair_lists(ends, pairs)

    both = (F.size(deleted) > 0) & (F.size(added) > 0)
    once = matched.asNondeterministic()  # else a filter on the pairs, as `inline` brings one, matches a second time
    return once(F.when(both, deleted), F.when(both, added))


def _block_pairs(long: DataFrame, threshold: int, block: int) -> DataFrame:
    """Similar pairs of the listed revisions: rows (__rev, d, a, ratio) with places in the two lists.

    Every pair of blocks is a row of its own, dealt by revision and blocks, so one revision keeps many tasks busy.
    """
    blocks = lambda side: F.sequence(F.lit(0), F.floor((F.size(side) - 1) / block).cast("int"))
    part = lambda side, i: F.slice(side, F.col(i) * block + 1, F.lit(block))
    rows = long.select("__rev", "deleted", "added", F.explode(blocks("deleted")).alias("i"))
    rows = rows.select("*", F.explode(blocks("added")).alias("j"))
    rows = rows.select("__rev", "i", "j", part("deleted", "i").alias("old"), part("added", "j").alias("new"))
    tasks = int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rev, i, j, old, new in zip(*batch.columns, strict=True):
                d, a, ratios = similar_pairs(old.as_py(), new.as_py(), threshold)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(d), rev.as_py(), np.int64)), pa.array((d + i.as_py() * block).astype(np.int32)),
                     pa.array((a + j.as_py() * block).astype(np.int32)), pa.array(ratios.astype(np.int32))],
                    ["__rev", "d", "a", "ratio"],
                )

    return rows.repartition(tasks, "__rev", "i", "j").mapInArrow(compare, "__rev long, d int, a int, ratio int")


def _take_free(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of similar pairs that come revision by revision and best first, those whose sentences are both free."""
    rev, used = None, (set(), set())
    for batch in batches:
        revs = batch.column("__rev").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(revs)) + 1).tolist(), len(revs)] if len(revs) else []
        for start, end in zip(cuts, cuts[1:]):
            if revs[start] != rev:
                rev, used = revs[start], (set(), set())
            part = batch.slice(start, end - start)
            taken = list(_free_pairs(part.column("d").to_numpy(), part.column("a").to_numpy(), *used))
            yield part.take(pa.array(taken, pa.int64()))


def _match_in_blocks(long: DataFrame, threshold: int, block: int) -> DataFrame:
    """`texts_change` of revisions with many sentences, tier by tier.

    The similar pairs of a revision are sorted, best first, and pass as a stream: what is held is which sentences are taken.
    """
    long = materialize(long.withColumn("__rev", F.monotonically_increasing_id()), "long-lists")
    left, found = long.select("__rev", "deleted", "added"), []
    text = lambda side, place: F.get(side, F.col(place))
    for tier in _tiers(threshold):
        pairs = _block_pairs(left, tier, block)
        best_first = pairs.repartition("__rev").sortWithinPartitions("__rev", F.desc("ratio"), "d", "a")
        taken = best_first.mapInArrow(_take_free, best_first.schema)
        texts = taken.join(left, "__rev").select(
            "__rev", F.struct((-F.col("ratio")).alias("r"), text("deleted", "d").alias("before"), text("added", "a").alias("after")).alias("p")
        )
        lists = materialize(texts.groupBy("__rev").agg(F.array_sort(F.collect_list("p")).alias("p")), "taken")
        found.append(lists)
        rest = left.join(lists, "__rev", "left").select("__rev", *[
            F.coalesce(F.array_except(side, F.col(f"p.{name}")), side).alias(side)
            for side, name in (("deleted", "before"), ("added", "after"))
        ])
        left = materialize(rest.where((F.size("deleted") > 0) & (F.size("added") > 0)), "left-lists")
    whole = found[0]
    for lists in found[1:]:
        whole = whole.unionByName(lists)
    per_rev = whole.groupBy("__rev").agg(F.array_sort(F.flatten(F.collect_list("p"))).alias("p"))
    change = F.transform(F.coalesce("p", F.array().cast(per_rev.schema["p"].dataType)), lambda x: x.dropFields("r"))
    return long.join(per_rev, "__rev", "left").withColumn("texts_change", change.cast(S.CHANGE_PAIRS)).drop("__rev", "p")


def match_sentence_sets(
    sets: DataFrame, threshold: int = S.SIMILARITY_THRESHOLD, pairs_per_call: int = PAIRS_PER_CALL, block: int = BLOCK
) -> DataFrame:
    """Adds `texts_change` to rows with `deleted` and `added`, sorted lists of distinct sentences.

    The rows are read twice, so they should be a written table. Both ways give the same pairs.
    """
    many = F.size("deleted").cast("long") * F.size("added") > pairs_per_call
    short = sets.where(~many).withColumn("texts_change", match_changed_sentences(F.col("deleted"), F.col("added"), threshold))
    long = sets.where(many)
    if long.isEmpty():
        return short
    return short.unionByName(_match_in_blocks(long, threshold, block))


def diff_lines(
    df: DataFrame, keys: Sequence[str] = S.KEYS, parent: str = PARENT_TEXT, current: str = CURRENT_TEXT,
    threshold: int = S.SIMILARITY_THRESHOLD, drop_empty: bool = False, partitions: int | None = None, dealt: bool = False,
) -> DataFrame:
    """Per revision with a text difference: inserted and removed sentences, and changed pairs.

    Sentences that are equal on both sides cancel first, so that moved lines are no difference.
    """
    sets = materialize(sentence_sets(line_set_diff(df, keys, parent, current, drop_empty, partitions, dealt), keys), "sentence-sets")
    return match_sentence_sets(sets, threshold).select(
        *keys,
        F.array_except("deleted", F.col("texts_change.before")).alias("texts_removed"),
        F.array_except("added", F.col("texts_change.after")).alias("texts_insert"),
        "texts_change",
    )


def diff_lines_grouped(
    df: DataFrame, node_type: str = "node_type", keys: Sequence[str] = S.KEYS, parent: str = PARENT_TEXT,
    current: str = CURRENT_TEXT, threshold: int = S.SIMILARITY_THRESHOLD,
) -> DataFrame:
    """The same per revision and node type; empty lines are left out, and sentences with them."""
    return diff_lines(df, [*keys, node_type], parent, current, threshold, drop_empty=True)


def diff_or_empty(revisions: DataFrame, diffs: DataFrame, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """All revisions with their difference; none → empty lists, so that no row is lost."""
    empty = lambda kind: F.array().cast(kind)
    joined = revisions.join(diffs, list(keys), "left")
    filled = {
        "texts_removed": F.coalesce("texts_removed", empty("array<string>")),
        "texts_insert": F.coalesce("texts_insert", empty("array<string>")),
        "texts_change": F.coalesce("texts_change", empty(S.CHANGE_PAIRS)),
    }
    if "actions" in joined.columns:
        filled["actions"] = F.coalesce("actions", F.create_map().cast(T.MapType(T.StringType(), T.IntegerType())))
    return joined.withColumns(filled)


def pair_changed_nodes(
    nodes: DataFrame, keys: Sequence[str] = S.KEYS, threshold: int = S.SIMILARITY_THRESHOLD
) -> DataFrame:
    """Rows (keys, node_type, action `remove` or `insert`, text) → the same with similar nodes paired as `change`.

    Removed and inserted nodes of a revision and type are paired like sentences, each copy of a text with one copy. A pair
    is then compared sentence by sentence: similar ones become rows `change` with `text` and `text_after`, the others
    `remove` and `insert`; sentences the two nodes share are no difference.
    """
    by = [*keys, "node_type"]
    counts = nodes.groupBy(*by, "action", "text").agg(F.count(F.lit(1)).cast("int").alias("n"))
    side = lambda action: F.array_sort(F.collect_list(F.when(F.col("action") == action, F.struct("text", "n"))))
    sides = counts.groupBy(*by).agg(side("remove").alias("old"), side("insert").alias("new"))
    sets = materialize(sides.select("*", F.col("old.text").alias("deleted"), F.col("new.text").alias("added")), "node-sets")
    matched = match_sentence_sets(sets, threshold).select(*by, "old", "new", "texts_change").withColumns({
        "n_old": F.map_from_entries("old"), "n_new": F.map_from_entries("new"),
    })
    copies = lambda c: F.least(F.element_at("n_old", c["before"]), F.element_at("n_new", c["after"]))
    matched = materialize(matched.withColumn("pairs", F.transform(
        "texts_change", lambda c: F.struct(c["before"].alias("before"), c["after"].alias("after"), copies(c).alias("n"))
    )), "node-pairs")

    def rest(of: str, name: str, action: str) -> DataFrame:
        """Copies of a side's nodes that no pair has taken."""
        taken = F.map_from_entries(F.transform("pairs", lambda p: F.struct(p[name], p["n"])))
        rows = matched.select(*by, taken.alias("taken"), F.explode(of).alias("e"))
        left = F.col("e.n") - F.coalesce(F.element_at("taken", F.col("e.text")), F.lit(0))
        return rows.where(left > 0).select(
            *by, F.lit(action).alias("action"), F.explode(F.array_repeat("e.text", left)).alias("text"), F.lit(None).cast("string").alias("text_after")
        )

    pairs = matched.select(*by, F.posexplode("pairs").alias("__pair", "p")).select(
        *by, "__pair", F.col("p.before").alias(PARENT_TEXT), F.col("p.after").alias(CURRENT_TEXT), F.col("p.n").alias("__n")
    )
    inside = diff_lines(pairs, [*by, "__pair", "__n"], threshold=threshold)
    entry = lambda action, text, after: F.struct(F.lit(action).alias("action"), text.alias("text"), after.alias("text_after"))
    none = F.lit(None).cast("string")
    entries = F.concat(
        F.transform("texts_removed", lambda t: entry("remove", t, none)), F.transform("texts_insert", lambda t: entry("insert", t, none)),
        F.transform("texts_change", lambda c: entry("change", c["before"], c["after"])),
    )
    changed = inside.select(*by, "__n", F.inline(entries)).where((F.length("text") > 0) | (F.col("action") == "change"))
    changed = changed.select(*by, "action", F.explode(F.array_repeat("text", F.col("__n"))).alias("text"), "text_after")
    return rest("old", "before", "remove").unionByName(rest("new", "after", "insert")).unionByName(changed)


def collect_node_texts(
    nodes: DataFrame, kinds: Sequence[str] = S.NODE_TYPES, keys: Sequence[str] = S.KEYS
) -> DataFrame:
    """Rows (keys, node_type, action, text) → per revision three maps node type → texts.

    Nodes that went through `pair_changed_nodes` have a column `text_after`; their changes are (before, after) pairs.
    """
    paired = "text_after" in nodes.columns
    change = F.struct(F.col("text").alias("before"), F.col("text_after").alias("after")) if paired else F.col("text")
    wanted = nodes.where(F.col("node_type").isin(list(kinds)))
    per_type = wanted.groupBy(*keys, "node_type").agg(*[
        F.array_sort(F.collect_list(F.when(F.col("action") == a, change if a == "change" else F.col("text")))).alias(a)
        for a in ("remove", "insert", "change")
    ])
    texts = lambda a: F.map_from_entries(
        F.collect_list(F.when(F.size(a) > 0, F.struct("node_type", a)))
    )
    return per_type.groupBy(*keys).agg(
        texts("remove").alias("texts_removed"), texts("insert").alias("texts_insert"),
        texts("change").alias("texts_change"),
    )
