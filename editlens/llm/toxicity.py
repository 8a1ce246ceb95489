"""Toxicity from a learned lexicon, matched with spelling errors and read in context.

The lexicon holds words and word beginnings that toxic training texts use in many different contexts and clean ones do
not. A Levenshtein automaton of one edit is intersected with the lexicon's trie and made deterministic, so one table
lookup per character finds terms and misspelled terms alike. A window around each hit tells quotation and report from
abuse, and a logistic model turns a document's hits into a score.
"""

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editlens.functions.hashing import hash_order
from editlens.session import materialize

#: Bounds of the fit: labelled rows per class and lexicon entries. Everything else covers all rows.
ROWS_PER_CLASS = 10_000
ENTRIES = 1_000
MIN_CONTEXTS, MIN_LOG_ODDS, CHANCE = 5, 2.0, 0.1
STARTS = (4, 5, 6)
FUZZY_WORD, FUZZY_START = 5, 8
#: Context window in characters to each side, quotation marks, and words that report someone else's speech.
WINDOW = 80
QUOTES = "\"“”„«»‘’"
REPORTING = frozenset("said says wrote called quote quoted quotes sagte schrieb zitat dit écrit dijo escribió cita".split())
WORD = re.compile(r"[^\W_]+")
THRESHOLD = 0.7
FEATURES = 4
BATCH_CHARS = 1_000_000
PENDING = 100_000


def held_out(doc_id: Column) -> Column:
    """Rows no model may learn from; a null id is not held out, it has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Automaton:
    """Deterministic automaton of a lexicon {(term, is_start): weight} with one edit.

    Class 0 is the end of a word. `accept[state]` is 0, 1 for a term as listed, 2 for a misspelled one.
    """

    def __init__(self, lexicon: dict[tuple[str, bool], float]):
        letters = sorted({c for term, _ in lexicon for c in term})
        self.class_of = {c: i + 2 for i, c in enumerate(letters)}  # 1: any other letter
        children: list[dict[int, int]] = [{}]
        ends: list[tuple[float, float, bool, bool]] = [(0.0, 0.0, False, False)]  # word, start, each may be misspelled
        for (term, is_start), weight in sorted(lexicon.items()):
            at = 0
            for c in term:
                k = self.class_of[c]
                if k not in children[at]:
                    children[at][k] = len(children)
                    children.append({})
                    ends.append((0.0, 0.0, False, False))
                at = children[at][k]
            word, start, fuzzy_word, fuzzy_start = ends[at]
            if is_start:
                ends[at] = (word, max(start, weight), fuzzy_word, len(term) >= FUZZY_START)
            else:
                ends[at] = (max(word, weight), start, len(term) >= FUZZY_WORD, fuzzy_start)
        fuzzy = [e[2] or e[3] for e in ends]
        for at in reversed(range(len(children))):
            fuzzy[at] = fuzzy[at] or any(fuzzy[n] for n in children[at].values())
        kids = [[n for n in c.values() if fuzzy[n]] for c in children]

        def close(nodes: set[tuple[int, int]]) -> frozenset:
            """With the letters a writer may have left out."""
            return frozenset(nodes | {(n, 1) for at, e in nodes if e == 0 for n in kids[at]})

        def move(state: frozenset, k: int) -> frozenset:
            out = set()
            for at, e in state:
                n = children[at].get(k)
                if n is not None and (e == 0 or fuzzy[n]):
                    out.add((n, e))
                if e == 0:
                    if fuzzy[at]:
                        out.add((at, 1))
                    out.update((n, 1) for n in kids[at])
            return close(out)

        first = close({(0, 0)})
        numbers, todo = {frozenset(): 0, first: 1}, [first]
        table: list[list[int]] = [[0] * (len(letters) + 2)]
        rows: dict[int, dict[int, int]] = {}
        final: dict[tuple[int, float], int] = {}  # states that stay accepting whatever follows
        accept, weights = {0: 0}, {0: 0.0}
        while todo:
            state = todo.pop()
            me = numbers[state]
            word = max((ends[at][0] for at, e in state if e == 0), default=0.0)
            near = max((ends[at][0] for at, e in state if e == 1 and ends[at][2]), default=0.0)
            accept[me], weights[me] = (1, word) if word else (2, near) if near else (0, 0.0)
            known = {k for at, e in state for k in children[at]} | {
                k for at, e in state if e == 0 for n in kids[at] for k in children[n]
            }
            row = {}
            for k in [1, *sorted(known)]:
                to = move(state, k)
                start = max((ends[at][1] for at, e in to if e == 0), default=0.0)
                near_start = max((ends[at][1] for at, e in to if e == 1 and ends[at][3]), default=0.0)
                if start or near_start:
                    kind = (1, start) if start else (2, near_start)
                    if kind not in final:
                        final[kind] = -1 - len(final)
                    row[k] = final[kind]
                    continue
                if to not in numbers:
                    numbers[to] = len(numbers)
                    todo.append(to)
                row[k] = numbers[to]
            rows[me] = row
        count = len(numbers)
        table = np.zeros((count + len(final), len(letters) + 2), np.int32)
        for me, row in rows.items():
            fixed = {k: to if to >= 0 else count - 1 - to for k, to in row.items()}
            table[me, 1:] = fixed.pop(1)
            for k, to in fixed.items():
                table[me, k] = to
        for (kind, weight), mark in final.items():
            me = count - 1 - mark
            table[me, 1:] = me
            accept[me], weights[me] = kind, weight
        self.table = table
        self.accept = np.array([accept[i] for i in range(len(table))], np.int8)
        self.weight = np.array([weights[i] for i in range(len(table))], np.float64)

    def hits(self, codes: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, kinds and weights of the matching words in a run of code points; class 0 must end it."""
        inside = classes > 0
        starts = np.flatnonzero(inside[:-1] & ~np.concatenate([[False], inside[:-2]])) if len(codes) > 1 else np.empty(0, np.int64)
        state = np.ones(len(starts), np.int32)
        found = []
        at, origin = starts, starts
        while len(at):
            k = classes[at]
            over = k == 0
            if over.any():
                kind = self.accept[state[over]]
                good = kind > 0
                found.append((origin[over][good], kind[good], self.weight[state[over][good]]))
            state = self.table[state, k]
            alive = ~over & (state > 0)
            at, origin, state = at[alive] + 1, origin[alive], state[alive]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int8), np.empty(0)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points belong to words."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _is_reported(text: str, start: int) -> bool:
    """Quotation marks on both sides within the window, or a reporting word in it."""
    left, right = text[max(0, start - WINDOW):start], text[start:start + WINDOW]
    if any(q in left for q in QUOTES) and any(q in right for q in QUOTES):
        return True
    return not REPORTING.isdisjoint((left + " " + right).split())


def _features(texts: list[str], automaton: Automaton, class_table: np.ndarray) -> np.ndarray:
    """Per text the log of 1 + the weights of its hits: abusive as listed, misspelled; quoted as listed, misspelled."""
    lowered = [t.lower() for t in texts]
    joined = "\x00".join(lowered) + "\x00"
    codes = _codes(joined)
    starts, kinds, weights = automaton.hits(codes, class_table[codes])
    lengths = np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered))
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    owner = np.searchsorted(begins, starts, "right") - 1
    sums = np.zeros((len(texts), FEATURES))
    for start, kind, weight, of in zip(starts.tolist(), kinds.tolist(), weights.tolist(), owner.tolist(), strict=True):
        sums[of, 2 * _is_reported(lowered[of], start - int(begins[of])) + kind - 1] += weight
    return np.log1p(sums)


def with_features(docs: DataFrame, columns: list[str], lexicon: dict[tuple[str, bool], float]) -> DataFrame:
    """The named columns and `__x`, the features of the whole text. One pass, no shuffle."""
    columns = list(columns)
    automaton = Automaton(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letters()
        class_table = letters.astype(np.int16)
        for c, k in automaton.class_of.items():
            if letters[ord(c)]:
                class_table[ord(c)] = k
        for batch in batches:
            values, parts, texts, chars = batch.column("__text"), [], [], 0
            for value in values:
                text = value.as_py() or ""
                texts.append(text)
                chars += len(text)
                if chars > BATCH_CHARS:
                    parts.append(_features(texts, automaton, class_table))
                    texts, chars = [], 0
            if texts:
                parts.append(_features(texts, automaton, class_table))
            x = np.concatenate(parts) if parts else np.zeros((0, FEATURES))
            out = pa.Table.from_batches([batch]).select(columns)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))
            yield from out.append_column("__x", lists).to_batches()

    given = docs.select(*columns, docs["text"].alias("__text"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*columns).schema)
    return given.mapInArrow(run, f"{kept}__x array<double>")


def training_rows(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """Texts with label of at most so many rows per class, the first by hash; held-out rows are never among them.

    An id that is labelled twice counts as toxic if one label says so. At most twice the bound of ids is broadcast.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    chosen = [known.where(F.col("toxic") == k).orderBy(hash_order("doc_id"), "doc_id").limit(rows_per_class) for k in (0, 1)]
    return docs.select("doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").select("text", "toxic")


def _first_uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word of a text and each word beginning (marked `*`) once, with a hash of the word before its first use."""
    for batch in batches:
        toxic, found, before = [], [], []
        for k, (text, label) in enumerate(zip(batch.column("text"), batch.column("toxic"), strict=True)):
            words = WORD.findall((text.as_py() or "").lower())
            first = {}
            for w, b in zip(words, ["", *words[:-1]], strict=True):
                if w not in first:
                    first[w] = mark = zlib.crc32(b.encode())
                    for n in STARTS:
                        if n < len(w):
                            first.setdefault(w[:n] + "*", mark)
            found += first
            before += first.values()
            toxic += [label.as_py()] * len(first)
            if len(found) > PENDING or k == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(toxic, pa.int32()), pa.array(found, pa.string()), pa.array(np.array(before, np.uint32).view(np.int32))],
                    ["toxic", "word", "before"],
                )
                toxic, found, before = [], [], []


def learn_lexicon(rows: DataFrame, entries: int = ENTRIES) -> dict[tuple[str, bool], float]:
    """The words and word beginnings with the strongest evidence, with their log-odds.

    Evidence counts the distinct words before the first use in a text: neither copies of a text nor a text that repeats
    a word add to it. The log-likelihood ratio against the share of toxic contexts must be so high that among all
    candidates a tenth of one would reach it by chance.
    """
    pairs = rows.select("text", "toxic").mapInArrow(_first_uses, "toxic int, word string, before int")
    contexts = pairs.groupBy("word", "before").agg(F.max("toxic").alias("bad"), F.min("toxic").alias("good"))
    counts = materialize(contexts.groupBy("word").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("good")).alias("q")), "terms")
    totals = counts.where(~F.col("word").endswith("*")).agg(F.sum("p"), F.sum("q")).first()
    p_all, q_all = (float(v or 0) for v in totals)
    if not p_all or not q_all:
        return {}
    share = p_all / (p_all + q_all)
    odds = F.log((F.col("p") + 0.5) / (p_all + 1)) - F.log((F.col("q") + 0.5) / (q_all + 1))
    n = F.col("p") + F.col("q")
    term = lambda k, s: F.when(k > 0, k * F.log(k / (n * s))).otherwise(0.0)
    evidence = 2 * (term(F.col("p"), share) + term(F.col("q"), 1 - share))
    tried = counts.where(F.col("p") >= MIN_CONTEXTS)
    least = 2 * log(max(1, tried.count()) / CHANCE)
    best = (
        tried.select("word", odds.alias("w"), evidence.alias("g")).where((F.col("w") >= MIN_LOG_ODDS) & (F.col("g") >= least))
        .orderBy(F.col("g").desc(), "word").limit(entries)
    )
    return {(r["word"].rstrip("*"), r["word"].endswith("*")): r["w"] for r in best.collect()}


@dataclass(frozen=True)
class Model:
    """Lexicon and logistic weights; without weights every text scores `base`."""

    lexicon: dict[tuple[str, bool], float]
    weights: tuple[float, ...]
    bias: float
    base: float = 0.0


def learn(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> Model:
    """Fits lexicon and weights. Without labelled rows of both kinds there is nothing to find and every score is 0."""
    rows = materialize(training_rows(docs, labels, rows_per_class), "labelled")
    lexicon = learn_lexicon(rows)
    if not lexicon:
        return Model({}, (), 0.0)
    x = with_features(rows, ["toxic"], lexicon).select(array_to_vector("__x").alias("features"), F.col("toxic").cast("double").alias("label"))
    fitted = LogisticRegression(regParam=1e-4, standardization=False, maxIter=50).fit(materialize(x, "features"))
    return Model(lexicon, tuple(float(v) for v in fitted.coefficients), float(fitted.intercept))


def with_score(docs: DataFrame, columns: list[str], model: Model) -> DataFrame:
    """The named columns and `score`. A null or empty text has no hits. Named columns must not clash with `score`."""
    if not model.weights:
        return docs.select(*columns, F.lit(model.base).alias("score"))
    terms = [F.get("__x", F.lit(i)) * w for i, w in enumerate(model.weights)]
    total = sum(terms, F.lit(model.bias))
    return with_features(docs, columns, model.lexicon).select(*columns, (1 / (1 + F.exp(-total))).alias("score"))


def predicted(score: Column) -> Column:
    return (score >= THRESHOLD).cast("int")
