"""Text differences: similarity, matching and whole-job invariants."""

import itertools
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from editlens import schema as S
from editlens.functions.similarity import similar_pairs
from editlens.functions.text import category_links, common_length, ratio, similarity_ratio
from editlens.operators import diff, elements, markup

SHORT = st.text(alphabet="abcé .", max_size=12)


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@given(SHORT, SHORT)
@settings(max_examples=300, deadline=None)
def test_common_length(a, b):
    assert common_length(a, b) == plain_common(a, b)


def test_long_texts():
    rng = random.Random(3)
    a = "".join(rng.choice("abcdef ") for _ in range(400))
    b = "".join(rng.choice("abcdef ") for _ in range(300)) + a[100:200]
    assert common_length(a, b) == plain_common(a, b)


@given(SHORT, SHORT)
@settings(max_examples=200, deadline=None)
def test_ratio_is_symmetric_and_bounded(a, b):
    assert ratio(a, b) == ratio(b, a) and 0 <= ratio(a, b) <= 100 and ratio(a, a) == 100


def plain_match(deleted, added, threshold):
    pairs = sorted(
        (-ratio(d, a), d, a) for d, a in itertools.product(deleted, added) if ratio(d, a) > threshold
    )
    used_d, used_a, out = set(), set(), []
    for _, d, a in pairs:
        if d not in used_d and a not in used_a:
            used_d.add(d)
            used_a.add(a)
            out.append((d, a))
    return sorted(out)


SETS = st.lists(st.text(alphabet="abc ", min_size=1, max_size=10), max_size=7, unique=True)


@given(SETS, SETS)
@settings(max_examples=400, deadline=None)
def test_matching_against_all_pairs(deleted, added):
    added = [a for a in added if a not in deleted]
    for threshold in (60, 30):
        got = sorted((p["before"], p["after"]) for p in diff.match_sentences(sorted(deleted), sorted(added), threshold))
        assert got == plain_match(deleted, added, threshold)


LINES = st.lists(st.text(alphabet="abé🙂 ", max_size=9), max_size=8, unique=True)


@given(LINES, LINES, st.sampled_from([0, 30, 60, 90]))
@settings(max_examples=300, deadline=None)
def test_similar_pairs(first, second, threshold):
    got = sorted(zip(*map(np.ndarray.tolist, similar_pairs(first, second, threshold)), strict=True))
    want = sorted((i, j, ratio(a, b)) for i, a in enumerate(first) for j, b in enumerate(second) if a and b and ratio(a, b) > threshold)
    assert got == want


def test_similar_pairs_of_long_texts():
    rng = random.Random(8)
    first = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([5, 63, 64, 65, 128, 200, 900]))) for _ in range(40)]
    second = [t[: len(t) // 3] + t[len(t) // 3 + 7:] + "zz" for t in first] + first[:3]
    got = set(zip(*map(np.ndarray.tolist, similar_pairs(first, second, 60)), strict=True))
    assert got == {(i, j, ratio(a, b)) for i, a in enumerate(first) for j, b in enumerate(second) if ratio(a, b) > 60}


def sentence_lists(seed, n):
    """Lists of two revisions: edited sentences, and table rows that are all alike, so that ratios tie."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    old = {" ".join(rng.choice(words) for _ in range(rng.randint(3, 12))) for _ in range(n)}
    new = {re.sub("a", lambda m: rng.choice("ab"), t) for t in old} - old
    rows = {f"| row {i:03d} of the table" for i in range(n // 3)}
    return sorted(old | {r for r in rows if hash_of(r) % 2}), sorted(new | {r for r in rows if not hash_of(r) % 2})


def hash_of(text):
    return sum(map(ord, text)) * 31


def test_blocks_give_the_pairs_of_one_call(spark):
    rows = [("a", i, *reversed(sentence_lists(i, n))) for i, n in ((1, 40), (2, 90), (3, 7))] + [("a", 4, [], ["x y"]), ("a", 5, ["x"], [])]
    sets = spark.createDataFrame(rows, "wiki_db string, revision_id long, added array<string>, deleted array<string>")
    key = lambda df: {r[S.ID]: [tuple(c) for c in r["texts_change"]] for r in df.collect()}
    whole = key(diff.match_sentence_sets(sets))
    assert key(diff.match_sentence_sets(sets, pairs_per_call=100, block=13)) == whole
    for _, i, added, deleted in rows:
        assert sorted(whole[i]) == plain_match(deleted, added, S.SIMILARITY_THRESHOLD)


def test_one_large_revision_keeps_many_tasks_busy(spark):
    old, new = sentence_lists(9, 2500)
    sets = spark.createDataFrame([("a", 1, new, old)], "wiki_db string, revision_id long, added array<string>, deleted array<string>")
    long = sets.withColumn("__rev", F.lit(7).cast("long"))
    pairs = diff._block_pairs(long, S.SIMILARITY_THRESHOLD, 500).withColumn("task", F.spark_partition_id())
    tasks = pairs.groupBy("task").count().collect()
    assert len(tasks) > 3
    row = diff.match_sentence_sets(sets).first()
    assert len(old) * len(new) > diff.PAIRS_PER_CALL
    befores, afters = [c["before"] for c in row["texts_change"]], [c["after"] for c in row["texts_change"]]
    assert len(set(befores)) == len(befores) > 1000 and len(set(afters)) == len(afters)
    assert set(befores) <= set(old) and set(afters) <= set(new)


def test_similarity_column(spark):
    rows = [("kitten", "sitting"), ("abc", "abc"), ("", ""), ("", "x"), ("abcdef", "uvwxyz"), (None, "x")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(similarity_ratio(F.col("a"), F.col("b")), similarity_ratio(F.col("a"), F.col("b"), above=60)).collect()
    assert [r[0] for r in got] == [62, 100, 100, 0, 0, None]
    assert [r[1] for r in got] == [62, 100, None, None, None, None]


TEXTS = [
    ("a", 1, "Same. Text.", "Same. Text."),
    ("a", 2, "One sentence here. Another one.\nLast line.", "One sentence hear. Another one.\nLast line.\nNew stuff!"),
    ("a", 3, "moved\nstays\n", "stays\nmoved"),
    ("a", 4, "", "all new. text"),
    ("b", 1, "gone. away", ""),
    ("b", 2, "dup\ndup\nkeep", "dup\nkeep"),
]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(TEXTS, "wiki_db string, revision_id long, parent_text string, revision_text string")


def by_key(df):
    return {(r["wiki_db"], r["revision_id"]): r for r in df.collect()}


def test_diff_of_texts(pairs):
    rows = by_key(diff.diff_lines(pairs))
    assert ("a", 1) not in rows and ("a", 3) not in rows
    r = rows["a", 2]
    assert [tuple(c) for c in r["texts_change"]] == [("One sentence here", "One sentence hear")]
    assert r["texts_removed"] == [] and r["texts_insert"] == ["New stuff!"]
    assert rows["a", 4]["texts_insert"] == ["all new", "text"]
    assert rows["b", 1]["texts_removed"] == ["away", "gone"]
    assert rows["b", 2]["texts_removed"] == ["dup"]


def test_mirrored_texts_give_mirrored_diff(pairs):
    there = by_key(diff.diff_lines(pairs))
    back = by_key(diff.diff_lines(pairs.withColumnsRenamed({"parent_text": "x"}).withColumnsRenamed({"revision_text": "parent_text", "x": "revision_text"})))
    assert there.keys() == back.keys()
    for key, r in there.items():
        assert r["texts_removed"] == back[key]["texts_insert"] and r["texts_insert"] == back[key]["texts_removed"]
        assert {(c["before"], c["after"]) for c in r["texts_change"]} == {(c["after"], c["before"]) for c in back[key]["texts_change"]}


def test_rows_without_difference_stay(pairs):
    filled = by_key(diff.diff_or_empty(pairs.select(*S.KEYS), diff.diff_lines(pairs)))
    assert len(filled) == 6 and filled["a", 1]["texts_insert"] == [] and filled["a", 3]["texts_change"] == []


def test_element_actions(spark):
    old = "== H ==\n[[A]] and [[B]] and [[C]]. {{cite}} <!-- note -->"
    new = "== H ==\n[[B]] and [[A]] and [[D]]. {{cite}} {{new}}"
    df = spark.createDataFrame([("a", 1, old, new), ("a", 2, old, old)], "wiki_db string, revision_id long, parent_text string, revision_text string")
    rows = by_key(elements.edit_action_counts(df))
    assert list(rows) == [("a", 1)]
    actions = rows["a", 1]["actions"]
    assert actions["change_Wikilink"] == 1 and actions["move_Wikilink"] == 1  # one of the two has to move
    assert actions["insert_Template"] == 1 and actions["remove_Comment"] == 1
    assert not any(k.endswith("_Heading") for k in actions)


def test_common_start_and_end_stay_in_place(spark):
    df = spark.createDataFrame([("a", 1, "w x y w", "w y w"), ("a", 2, "p q", "q p")], "wiki_db string, revision_id long, parent_text string, revision_text string")
    rows = {(r["revision_id"], r["type"]): r for r in elements.element_actions(df, {"Word": r"\p{L}+"}).collect()}
    assert (rows[1, "Word"]["remove"], rows[1, "Word"]["move"]) == (1, 0)
    assert rows[2, "Word"]["move"] == 1


def test_node_texts(spark):
    df = spark.createDataFrame([("a", 1, "<ref>x</ref> t", "<ref>y</ref> t")], "wiki_db string, revision_id long, parent_text string, revision_text string")
    nodes = elements.node_texts(df, {"Reference": "(?s)<ref>.*?</ref>", "Text": "[a-z]+$"})
    row = diff.collect_node_texts(nodes).first()
    assert row["texts_insert"] == {"Reference": ["<ref>y</ref>"]} and row["texts_removed"] == {"Reference": ["<ref>x</ref>"]}


def test_changed_nodes(spark):
    rows = [
        ("a", 1, "<ref>Old book of maps</ref> <ref>quite unlike text</ref>", "<ref>Old books of maps</ref> <ref>0123456789 0123456789</ref>"),
        ("a", 2, "<ref>same one. second here</ref>" * 3, "<ref>same one. second there</ref>" * 2),
        ("a", 3, "<ref>x</ref>", "<ref>x</ref>"), ("b", 1, None, "<ref>fresh</ref>"), ("b", 2, "t", "u"),
    ]
    df = spark.createDataFrame(rows, PAIR_SCHEMA)
    nodes = diff.pair_changed_nodes(elements.node_texts(df, {"Reference": "<ref>([^<]*)</ref>", "Text": "^[a-z]$"}, group=0))
    found = by_key(diff.collect_node_texts(nodes))
    assert set(found) == {("a", 1), ("a", 2), ("b", 1), ("b", 2)}
    one, two = found["a", 1], found["a", 2]
    assert {k: [tuple(c) for c in v] for k, v in one["texts_change"].items()} == {"Reference": [("<ref>Old book of maps</ref>", "<ref>Old books of maps</ref>")]}
    assert one["texts_removed"] == {"Reference": ["<ref>quite unlike text</ref>"]} and one["texts_insert"] == {"Reference": ["<ref>0123456789 0123456789</ref>"]}
    # Two of three copies are changed, in one of their sentences; the third is gone.
    assert [tuple(c) for c in two["texts_change"]["Reference"]] == [("second here</ref>", "second there</ref>")] * 2
    assert two["texts_removed"] == {"Reference": ["<ref>same one. second here</ref>"]} and two["texts_insert"] == {}
    assert found["b", 1]["texts_insert"] == {"Reference": ["<ref>fresh</ref>"]} and found["b", 2]["texts_removed"] == {"Text": ["t"]}


def test_node_texts_of_wikitext(spark):
    df = spark.createDataFrame([("a", 1, "line one\n<ref>{{cite|a}} x</ref>", "line one\n<ref>{{cite|b}} y</ref>\nmore")], PAIR_SCHEMA)
    rows = {(r.node_type, r.action, r.text) for r in elements.node_texts(df).collect()}
    ref = lambda x: ("Reference", f"<ref>{markup.MARK} {x}</ref>")
    assert {(k, t) for k, a, t in rows if a == "remove" and k == "Reference"} == {ref("x")}
    assert {(k, t) for k, a, t in rows if a == "insert" and k == "Reference"} == {ref("y")}
    assert ("Text", "insert", "more") in rows


def test_categories(spark):
    df = spark.createDataFrame([("[[Category:A, b]] [[kategorie:C:d]] [[File:x]] [[plain]]", ["category", "kategorie"])], "t string, al array<string>")
    assert df.select(category_links(F.col("t"), F.col("al"))).first()[0] == ["A b", "C:d"]


WIKITEXT = """{{{arg|x}}} [[Category:A]] [[Kategorie:B]] <!-- a
note --> https://example.org/x <GALLERY mode=a>
a.png</Gallery> &amp; &#160;
== Head ==
=== Sub ===
* item
# two
[[File:a.png|thumb]] [[IMAGE:b.png]] <ref name=a>text</ref> <REF name=b/> {|
! head
| cell
|}
{{cite|a}} ''it'' '''bold''' [[Link|label]]. Some words, here!
"""


def test_required_text_never_hides_a_match(spark):
    df = spark.createDataFrame([("a", 1, WIKITEXT), ("a", 2, "plain words"), ("a", 3, "")], "wiki_db string, revision_id long, t string")
    # The same patterns in a group of their own are not known by name and run on every text.
    always = {k: f"(?:{p})" for k, p in elements.WIKITEXT_PATTERNS.items()}
    fast, plain = elements.extract_elements(df, "t"), elements.extract_elements(df, "t", always)
    flat = fast.where(F.col("type").isin(list(always)))
    assert flat.exceptAll(plain).count() == 0 and plain.exceptAll(flat).count() == 0
    found = {r["type"] for r in fast.where("revision_id = 1").select("type").distinct().collect()}
    assert found == set(S.CONTENT_TYPES)


PAIR_SCHEMA = "wiki_db string, revision_id long, parent_text string, revision_text string"
FLAT_BRACKETS = {
    "Argument": r"\{{3}[^{}]*\}{3}", "Template": r"(?<!\{)\{\{(?!\{)[^{}]*\}\}", "Link": r"\[\[[^\[\]]*\]\]", "Comment": r"(?s)<!--.*?-->",
    "Reference": r"(?is)<ref[^<>]*/>|<ref(?:\s[^<>]*[^<>/])?>.*?</ref>", "Gallery": r"(?is)<gallery[^<>]*>.*?</gallery>", "Table": r"(?s)\{\|.*?\|\}",
}


def test_scan_of_flat_markup():
    """Without nesting and with all brackets closed, the scan finds what a pattern per type finds."""
    rng = random.Random(4)
    pieces = ["{{a|b}}", "{{{x}}}", "[[A|b]]", "[[File:q]]", "<!-- [[no]] -->", "<ref>r</ref>", "<REF name=x/>", "<ref name=a>z</ref>",
              "<gallery>\nq\n</gallery>", "{|\n| c\n|}", "w ", "\n", " } ] | < "]
    for _ in range(300):
        text = " ".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        visible = re.sub(FLAT_BRACKETS["Comment"], "", text)
        want = sorted((k, v) for k, p in FLAT_BRACKETS.items() for v in re.findall(p, text if k == "Comment" else visible))
        assert sorted(markup.bracketed(text)) == want


def test_scan_of_nested_markup():
    m = markup.MARK
    text = "{{a|{{b}}|}} [[File:x.png|a [[b]] c]] {{{arg|{{d}}}}} <ref>see {{cite|x}}</ref><!-- {{no}} -->{{x [[y}} ]] {{{t}}"
    assert markup.bracketed(text) == [
        ("Template", f"{{{{a|{m}|}}}}"), ("Template", "{{b}}"), ("Link", f"[[File:x.png|a {m} c]]"), ("Link", "[[b]]"),
        ("Argument", f"{{{{{{arg|{m}}}}}}}"), ("Template", "{{d}}"), ("Reference", f"<ref>see {m}</ref>"), ("Template", "{{cite|x}}"),
        ("Comment", "<!-- {{no}} -->"), ("Template", "{{x [[y}}"), ("Template", "{{t}}"),
    ]


HARD = st.lists(st.sampled_from(["{{{", "{{", "}}", "}", "[[", "]]", "{|", "|}", "<!--", "-->", "<ref>", "<ref x/>", "</ref>", "<gallery>", "</gallery>", "a", "|"]), max_size=25)


@given(HARD)
@settings(max_examples=500, deadline=None)
def test_values_are_no_longer_than_the_text(parts):
    text = "".join(parts)
    found = markup.bracketed(text)
    assert sum(len(v.replace(markup.MARK, "")) for _, v in found) <= len(text)
    for kind, value in found:
        assert value[:2] in ("{{", "[[", "{|", "<r", "<g", "<!"), (kind, value)


@pytest.mark.parametrize("text", [
    "<ref>a\n" * 100_000, "{{ [[ {| " * 50_000 + "}}" * 50_000, "{{" * 100_000 + "}}" * 100_000, "<!-- a\n" * 100_000, "<ref " * 100_000,
    "[[" * 100_000 + "}}" * 100_000, "<ref>{{</ref>" * 50_000, "{{[[" * 100_000 + "]]" * 100_000, "<gallery>\n" * 100_000, "{|\n" * 100_000,
], ids=range(10))
def test_unclosed_markup_takes_linear_time(text):
    start = time.process_time()
    markup.bracketed(text)
    assert time.process_time() - start < 10


def test_page_of_unclosed_tags(spark):
    lines = "<ref>a {{b [[c <!-- d\n" * 100_000
    df = spark.createDataFrame([("a", 1, lines, lines + "<ref>e</ref>")], PAIR_SCHEMA)
    start = time.monotonic()
    assert elements.edit_action_counts(df).first()["actions"]["insert_Reference"] == 1
    assert time.monotonic() - start < 60


def longest_run(places):
    best = [1] * len(places)
    for i, p in enumerate(places):
        best[i] = 1 + max((best[j] for j in range(i) if places[j] < p), default=0)
    return max(best, default=0)


def test_moves_are_the_fewest(spark):
    rng = random.Random(6)
    lists = [rng.sample(range(30), rng.randint(0, 12)) for _ in range(200)] + [None, [], list(range(50))]
    got = spark.createDataFrame([(v,) for v in lists], "p array<int>").select(F.col("p"), markup.out_of_order(F.array("p", "p"))[1].alias("n")).collect()
    for row in got:
        assert row.n == len(row.p or ()) - longest_run(row.p or ())


def test_a_rotation_is_one_move(spark):
    df = spark.createDataFrame([("a", 1, "one two three four five", "two three four five one"), ("a", 2, "a b c d", "d c b a")], PAIR_SCHEMA)
    rows = {r["revision_id"]: r["actions"] for r in elements.edit_action_counts(df).collect()}
    assert rows[1]["move_Word"] == 1 and rows[2]["move_Word"] == 3
    assert not any(k in rows[1] for k in ("insert_Word", "remove_Word", "change_Word"))


def test_nested_edit_counts_once(spark):
    df = spark.createDataFrame([("a", 1, "{{box|{{cite|a}}}}", "{{box|{{cite|b}}}}")], PAIR_SCHEMA)
    actions = elements.edit_action_counts(df).first()["actions"]
    assert actions["change_Template"] == 1


def test_link_types_by_language(spark):
    text = "[[Kategorija:X]] [[Datei:z.png]] [[KATEGORIE:ä]] [[КАТЕГОРИЯ:y]] [[:Category:no]] [[Category:A,b:c]] [[plain]] [[ Image : q ]]"
    df = spark.createDataFrame([("dewiki", 1, text), ("ruwiki", 2, text), ("enwiki", 3, text), ("dewiki", 4, None)], "wiki_db string, revision_id long, t string")
    aliases = spark.createDataFrame(
        [("de", "Kategorija", "Category"), ("de", "Datei", "Media"), ("de", "kategorie", "Category"), ("de", "Kategorie", "Category"),
         ("ru", "Категория", "Category"), ("fr", "Datei", "Category"), ("de", "Category", "Media")], "lang string, alias string, type string")
    names = {r["revision_id"]: r["categories"] for r in elements.extract_categories(df, "t", aliases).collect()}
    assert names == {1: ["X", "ä", "Ab:c"], 2: ["y", "Ab:c"], 3: ["Ab:c"], 4: []}
    counts = {(r["revision_id"], r["type"]): r["n"] for r in elements.extract_elements(df, "t", aliases=aliases).groupBy(S.ID, "type").agg(F.count("*").alias("n")).collect()}
    assert [counts[i, "Media"] for i in (1, 2, 3)] == [2, 1, 1] and [counts[i, "Wikilink"] for i in (1, 2, 3)] == [3, 5, 6]


def test_long_page_of_lines(spark):
    lines = "\n".join(f"* line {i} of a list" for i in range(100_000))
    df = spark.createDataFrame([("a", 1, lines, lines + "\n* one more")], "wiki_db string, revision_id long, parent_text string, revision_text string")
    actions = elements.edit_action_counts(df).first()["actions"]
    assert actions["change_Paragraph"] == 1 and actions["insert_List"] == 1
