"""Queries: sentences, differences, elements, fragments and their features."""

from pyspark.sql import functions as F

from editlens import schema as S
from editlens.checks.fixtures import HTML_PATTERNS, LINK_ALIASES, Tables
from editlens.checks.registry import query
from editlens.functions.text import similarity_ratio, split_lines, split_sentences
from editlens.operators import diff, elements, fragments as Fr, metrics as M
from editlens.session import materialize

ID, WIKI, LABEL = S.ID, S.WIKI, S.LABEL
R6 = lambda c, name=None: F.round(c, 6).alias(name or c)
Y = "CAST(revision_is_identity_reverted AS INT)"

# A text is cut at `.`, `!`, `?` unless that ends it: cut all but the last character, which is put back after.
_SENTENCES = """list_transform(regexp_split_to_array(concat(regexp_replace(left({x}, length({x}) - 1), '[.!?]', chr(1), 'g'), right({x}, 1)), chr(1)),
lambda s: regexp_replace(regexp_replace(s, '^[\\s\\x0B]+', ''), '[\\s\\x0B]+$', ''))"""
_LINES = "regexp_split_to_array(regexp_replace({x}, '\\n$', ''), '\\n')"


@query(f"""SELECT revision_id, i AS place, s AS sentence FROM (SELECT doc_id AS revision_id, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS i
FROM (SELECT doc_id, {_SENTENCES.format(x='text')} AS ss FROM documents))""")
def split_sentences_rows(t: Tables):
    rows = t.table("documents").select(F.col("doc_id").alias(ID), F.posexplode(split_sentences(F.col("text"))))
    return rows.select(ID, F.col("pos").cast("long").alias("place"), F.col("col").alias("sentence"))


@query(f"""SELECT doc_id AS revision_id, len(ss) AS sentences, md5(array_to_string(ss, '|')) AS digest
FROM (SELECT doc_id, {_SENTENCES.format(x='text')} AS ss FROM documents)""", name="split_sentences")
def _split_sentences(t: Tables):
    rows = t.table("documents").select(F.col("doc_id").alias(ID), split_sentences(F.col("text")).alias("ss"))
    return rows.select(ID, F.size("ss").cast("long").alias("sentences"), F.md5(F.array_join("ss", "|")).alias("digest"))


@query(f"""SELECT doc_id AS revision_id, len(ss) AS sentences, md5(array_to_string(ss, '|')) AS digest FROM (
SELECT doc_id, flatten(list_transform({_LINES.format(x='text')}, lambda l: {_SENTENCES.format(x='l')})) AS ss FROM documents)""")
def flatten_lists(t: Tables):
    nested = F.transform(split_lines(F.col("text")), split_sentences)
    rows = t.table("documents").select(F.col("doc_id").alias(ID), F.flatten(nested).alias("ss"))
    return rows.select(ID, F.size("ss").cast("long").alias("sentences"), F.md5(F.array_join("ss", "|")).alias("digest"))


_DELTAS = f"""l AS (SELECT revision_id, wiki_db, unnest({_LINES.format(x='revision_text')}) AS line, 1 AS w FROM pairs WHERE revision_text <> parent_text
UNION ALL SELECT revision_id, wiki_db, unnest({_LINES.format(x='parent_text')}), -1 FROM pairs WHERE revision_text <> parent_text),
d AS (SELECT revision_id, wiki_db, line, sum(w)::BIGINT AS delta FROM l GROUP BY ALL HAVING sum(w) <> 0)"""


@query(f"WITH {_DELTAS} SELECT * FROM d")
def line_set_diff(t: Tables):
    return diff.line_set_diff(t.pairs)


@query(f"""WITH {_DELTAS},
s AS (SELECT DISTINCT revision_id, delta > 0 AS new, unnest({_SENTENCES.format(x='line')}) AS s FROM d),
o AS (SELECT revision_id, s, bool_or(new) AS a, bool_or(NOT new) AS b FROM s GROUP BY ALL)
SELECT revision_id, s AS sentence, CASE WHEN a THEN 'added' ELSE 'deleted' END AS side FROM o WHERE a <> b""")
def sentence_set_ops(t: Tables):
    sets = diff.sentence_sets(diff.line_set_diff(t.pairs), S.KEYS)
    rows = sets.select(ID, F.inline(F.arrays_zip(
        F.array(F.lit("added"), F.lit("deleted")).alias("side"), F.array("added", "deleted").alias("texts")
    )))
    return rows.select(ID, F.explode("texts").alias("sentence"), "side")


@query()
def diff_lines(t: Tables):
    return diff.diff_lines(t.pairs).select(
        *S.KEYS, F.size("texts_removed").alias("removed"), F.size("texts_insert").alias("inserted"),
        F.size("texts_change").alias("changed"),
    )


@query()
def diff_lines_grouped(t: Tables):
    nodes = t.pairs.withColumn("node_type", F.when(F.col(ID) % 3 == 0, "Reference").otherwise("Text"))
    return diff.diff_lines_grouped(nodes).select(
        *S.KEYS, "node_type", F.size("texts_removed").alias("removed"), F.size("texts_insert").alias("inserted"),
        F.size("texts_change").alias("changed"),
    )


@query()
def match_changed_sentences(t: Tables):
    sets = materialize(diff.sentence_sets(diff.line_set_diff(t.pairs), S.KEYS), "sentence-sets")
    return diff.match_sentence_sets(sets).select(*S.KEYS, F.inline("texts_change"))


# What every matching must keep, whatever its pairs: all sentences of both sides are there once, pairs are similar, and among
# what is left over no two sentences are.
def _kept_sql(deltas: str, keys: str) -> str:
    return f"""WITH {deltas},
s AS (SELECT DISTINCT {keys}, delta > 0 AS new, unnest({_SENTENCES.format(x='line')}) AS s FROM d),
o AS (SELECT {keys}, s, bool_or(new) AS a, bool_or(NOT new) AS b FROM s GROUP BY ALL)
SELECT {keys}, count(*) FILTER (WHERE b AND NOT a)::INT AS deleted, count(*) FILTER (WHERE a AND NOT b)::INT AS added,
  md5(coalesce(string_agg(s, '|' ORDER BY s) FILTER (WHERE b AND NOT a), '')) AS deleted_digest,
  md5(coalesce(string_agg(s, '|' ORDER BY s) FILTER (WHERE a AND NOT b), '')) AS added_digest,
  0 AS unlike_pairs, 0 AS missed_pairs FROM o GROUP BY {keys}"""


def _kept(diffs, keys):
    """Sentences of both sides as the difference holds them, and a second look at its pairs and at what it left over."""
    sides = {"deleted": ("texts_removed", "before"), "added": ("texts_insert", "after")}
    diffs = materialize(diffs, "diffs")  # read twice, matched once
    lists = diffs.select(*keys, "texts_change", "texts_removed", "texts_insert", *[
        F.array_sort(F.concat(rest, F.col(f"texts_change.{name}"))).alias(side) for side, (rest, name) in sides.items()
    ])
    pairs = lists.select(*keys, F.explode("texts_change").alias("c")).withColumn("ratio", similarity_ratio(F.col("c.before"), F.col("c.after")))
    unlike = pairs.where(~(F.col("ratio") > S.SIMILARITY_THRESHOLD)).groupBy(*keys).agg(F.count("*").cast("int").alias("unlike"))
    missed = F.size(diff.match_changed_sentences(F.col("texts_removed"), F.col("texts_insert")))
    return lists.join(unlike, keys, "left").select(
        *keys, *[F.size(side).alias(side) for side in sides], *[F.md5(F.array_join(side, "|")).alias(f"{side}_digest") for side in sides],
        F.coalesce("unlike", F.lit(0)).alias("unlike_pairs"), F.greatest(missed, F.lit(0)).alias("missed_pairs"),
    )


@query(_kept_sql(_DELTAS, "revision_id, wiki_db"))
def diff_lines_kept(t: Tables):
    return _kept(diff.diff_lines(t.pairs), S.KEYS)


@query(_kept_sql(_DELTAS.replace("HAVING sum(w) <> 0)", "HAVING sum(w) <> 0 AND line <> '')"), "revision_id, wiki_db").replace(
    "0 AS unlike_pairs", "CASE WHEN revision_id % 3 = 0 THEN 'Reference' ELSE 'Text' END AS node_type, 0 AS unlike_pairs"))
def diff_lines_grouped_kept(t: Tables):
    nodes = t.pairs.withColumn("node_type", F.when(F.col(ID) % 3 == 0, "Reference").otherwise("Text"))
    return _kept(diff.diff_lines_grouped(nodes), [*S.KEYS, "node_type"])


@query(_kept_sql(_DELTAS, "revision_id, wiki_db"))
def match_changed_sentences_kept(t: Tables):
    """The same of the matching in blocks: every revision's lists are compared by many tasks."""
    sets = materialize(diff.sentence_sets(diff.line_set_diff(t.pairs), S.KEYS), "sentence-sets")
    matched = diff.match_sentence_sets(sets, pairs_per_call=10_000, block=200)
    return _kept(matched.select(
        *S.KEYS, F.array_except("deleted", F.col("texts_change.before")).alias("texts_removed"),
        F.array_except("added", F.col("texts_change.after")).alias("texts_insert"), "texts_change",
    ), S.KEYS)


# Longest common subsequence row by row: one list per pair, one step per character of the first text.
@query("""WITH RECURSIVE p AS (SELECT DISTINCT event_type AS a, concat('user', user_id % 40, ' ', event_type, ' ', user_id % 7) AS b FROM events),
lcs(a, b, i, row) AS (
  SELECT a, b, 0, list_transform(range(0, length(b) + 1), lambda x: 0) FROM p
  UNION ALL
  SELECT a, b, i + 1, list_transform(range(1, length(b) + 2), lambda k: list_max(list_transform(range(1, k + 1), lambda j:
    greatest(row[j], CASE WHEN j > 1 AND b[j - 1] = a[i + 1] THEN row[j - 1] + 1 ELSE 0 END)))) FROM lcs WHERE i < length(a)),
r AS (SELECT a, b, CAST(round_even(200 * row[length(b) + 1] / CAST(length(a) + length(b) AS DOUBLE), 0) AS INT) AS ratio
  FROM lcs WHERE i = length(a))
SELECT e.event_id, r.ratio, CASE WHEN r.ratio > 60 THEN r.ratio END AS similar FROM events e JOIN r
ON r.a = e.event_type AND r.b = concat('user', e.user_id % 40, ' ', e.event_type, ' ', e.user_id % 7)""", name="similarity_ratio")
def _similarity_ratio(t: Tables):
    a = F.col("event_type")
    b = F.concat(F.lit("user"), F.col("user_id") % 40, F.lit(" "), a, F.lit(" "), F.col("user_id") % 7)
    pairs = t.table("events").select("event_id", a.alias("a"), b.alias("b"))
    ratios = pairs.select("a", "b").distinct().withColumns({
        "ratio": similarity_ratio(F.col("a"), F.col("b")), "similar": similarity_ratio(F.col("a"), F.col("b"), above=60)
    })
    return pairs.join(ratios, ["a", "b"]).select("event_id", "ratio", "similar")


_NODES = """n AS (SELECT page_id AS revision_id, type, value, 1 AS w FROM html_elements WHERE page_id > 0
UNION ALL SELECT page_id + 1, type, value, -1 FROM html_elements WHERE page_id + 1 IN (SELECT page_id FROM pages)),
nd AS (SELECT revision_id, type, value, sum(w)::BIGINT AS d FROM n GROUP BY ALL HAVING sum(w) <> 0)"""


@query(f"""WITH {_NODES} SELECT revision_id, type AS node_type, CASE WHEN d > 0 THEN 'insert' ELSE 'remove' END AS action,
sum(abs(d))::BIGINT AS row_count, sum(length(value) * abs(d))::BIGINT AS letters FROM nd WHERE type IN ('Text', 'Reference') GROUP BY ALL""")
def collect_node_texts(t: Tables):
    nodes = elements.node_texts(t.page_pairs, HTML_PATTERNS, [ID], group=1)
    maps = diff.collect_node_texts(nodes, keys=[ID])
    rows = maps.select(ID, F.lit("insert").alias("action"), F.explode("texts_insert").alias("node_type", "texts")).unionByName(
        maps.select(ID, F.lit("remove").alias("action"), F.explode("texts_removed").alias("node_type", "texts"))
    )
    letters = F.aggregate("texts", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return rows.select(ID, "node_type", "action", F.size("texts").cast("long").alias("row_count"), letters.alias("letters"))


# References, by how the pages were edited: one reworded and cut in two sentences, one dropped, one added.
@query("""SELECT revision_id, 'Reference' AS node_type, action, CASE WHEN starts_with(t, '<ref name=a>') OR starts_with(t, 'On') THEN concat(t, source, '</ref>') ELSE t END AS before, after
FROM markup JOIN (VALUES (1, 'change', '<ref name=a>Book of ', '<ref name=a page=2>Books'), (1, 'insert', 'On ', NULL),
  (4, 'remove', '<ref name=b/>', NULL), (0, 'insert', '<ref>new</ref>', NULL)) v(last_digit, action, t, after) ON revision_id % 10 = last_digit
WHERE last_digit <> 1 OR revision_id % 20 = 1""")
def collect_node_texts_changed(t: Tables):
    nodes = elements.node_texts(t.markup, kinds=["Reference"], aliases=t.link_aliases)
    maps = diff.collect_node_texts(diff.pair_changed_nodes(nodes), ["Reference"])
    none = F.lit(None).cast("string")
    rows = [
        maps.select(ID, F.explode(column).alias("node_type", "texts")).select(ID, "node_type", F.explode("texts").alias("t")).select(
            ID, "node_type", F.lit(action).alias("action"),
            *([F.col("t.before").alias("before"), F.col("t.after").alias("after")] if action == "change" else [F.col("t").alias("before"), none.alias("after")]),
        )
        for column, action in (("texts_removed", "remove"), ("texts_insert", "insert"), ("texts_change", "change"))
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


_LIST_SAME = "coalesce(list_position(list_transform(list_zip({0}, {1}), lambda z: z[1] IS NOT DISTINCT FROM z[2]), false) - 1, greatest(len({0}), len({1})))"

# Elements per revision and type as two lists `o` and `n` in table e → gained, lost and moved ones in table a. What moved is
# what a longest increasing run of new places leaves over: one list of least run ends, extended place by place.
_ACTIONS = f"""e2 AS (SELECT *, {_LIST_SAME.format('o', 'n')} AS p FROM e WHERE len(o) + len(n) > 0),
f AS (SELECT revision_id, type, list_reverse(o[p + 1:]) AS o, list_reverse(n[p + 1:]) AS n FROM e2),
g AS (SELECT *, {_LIST_SAME.format('o', 'n')} AS q FROM f),
m AS (SELECT revision_id, type, list_reverse(o[q + 1:]) AS o, list_reverse(n[q + 1:]) AS n FROM g),
x AS (SELECT revision_id, type, 'old' AS side, unnest(o) AS value, generate_subscripts(o, 1) AS place FROM m
UNION ALL SELECT revision_id, type, 'new', unnest(n), generate_subscripts(n, 1) FROM m),
o AS (SELECT *, row_number() OVER (PARTITION BY revision_id, type, side, value ORDER BY place) AS copy FROM x),
c AS (SELECT revision_id, type, value, copy, max(place) FILTER (WHERE side = 'old') AS old, max(place) FILTER (WHERE side = 'new') AS new
  FROM o GROUP BY ALL),
s AS (SELECT revision_id, type, count(*) FILTER (WHERE old IS NULL) AS gained, count(*) FILTER (WHERE new IS NULL) AS lost,
  coalesce(list(new ORDER BY old) FILTER (WHERE old IS NOT NULL AND new IS NOT NULL), []) AS places FROM c GROUP BY ALL),
r AS (SELECT revision_id, type, gained, lost, CASE WHEN places = list_sort(places) THEN 0 ELSE len(places) - len(list_reduce(
  list_transform(places, lambda p: [p]), lambda t, p: list_concat(t[:len(list_filter(t, lambda v: v < p[1]))], p, t[len(list_filter(t, lambda v: v < p[1])) + 2:])
  )) END AS move FROM s),
a AS (SELECT revision_id, type, coalesce(gained, 0) AS gained, coalesce(lost, 0) AS lost, coalesce(move, 0) AS move
  FROM m LEFT JOIN r USING (revision_id, type))"""


def _pattern_lists(table: str, patterns: dict, group: int) -> str:
    return " UNION ALL ".join(
        f"""SELECT revision_id, '{kind}' AS type, regexp_extract_all(parent_text, '{pattern.replace("'", "''")}', {group}) AS o,
        regexp_extract_all(revision_text, '{pattern.replace("'", "''")}', {group}) AS n FROM {table}"""
        for kind, pattern in patterns.items()
    )


_ACTION_COLUMNS = ", ".join(
    f"""coalesce(max({expr}) FILTER (WHERE type = '{kind}'), 0)::INT AS "{action}_{kind}" """
    for kind in S.CONTENT_TYPES
    for action, expr in (("change", "least(gained, lost)"), ("insert", "gained - least(gained, lost)"), ("move", "move"),
                         ("remove", "lost - least(gained, lost)"))
)

# The oracle's own rules, for pages whose brackets are closed: lines by their first sign, brackets by what is left when inner
# ones have become a mark, links by a list of prefixes per language.
_LINES_OF = "string_split({x}, chr(10))"
_PREFIX = "lower(split_part(v[3:], ':', 1))"
_MARKUP_RULES = {
    "Argument": r"regexp_extract_all({x}, '[{{]{{3}}[^{{}}]*[}}]{{3}}')",
    "Template": r"regexp_extract_all(regexp_replace({x}, '[{{]{{3}}[^{{}}]*[}}]{{3}}', chr(65532), 'g'), '[{{]{{2}}[^{{}}]*[}}]{{2}}')",
    "Comment": "list_transform(list_filter(string_split({x}, '<!--')[2:], lambda v: contains(v, '-->')), lambda v: concat('<!--', split_part(v, '-->', 1), '-->'))",
    "Gallery": "list_transform(string_split({x}, '<gallery>')[2:], lambda v: concat('<gallery>', split_part(v, '</gallery>', 1), '</gallery>'))",
    "Table": "list_transform(string_split({x}, concat('{{', '|', chr(10)))[2:], lambda v: concat('{{|', chr(10), split_part(v, '|}}', 1), '|}}'))",
    "Reference": "list_transform(list_filter(string_split({x}, '<ref')[2:], lambda v: contains(v, '/>') OR contains(v, '</ref>')), "
                 "lambda v: concat('<ref', CASE WHEN ends_with(split_part(v, '>', 1), '/') THEN concat(split_part(v, '>', 1), '>') "
                 "ELSE concat(split_part(v, '</ref>', 1), '</ref>') END))",
    "Link": r"regexp_extract_all({x}, '\[\[[^\[\]]*\]\]')",
    "Heading": "list_filter(list_transform({lines}, lambda v: regexp_extract(v, '^=+[^=]+=+')), lambda v: v <> '')",
    "Section": "list_filter(list_transform({lines}, lambda v: regexp_extract(v, '^==[^=]+==')), lambda v: v <> '')",
    "List": "list_filter({lines}, lambda v: v <> '' AND contains('*#:;', v[1]))",
    "Table Element": "list_filter({lines}, lambda v: v <> '' AND contains('|!', v[1]) AND v[2] <> '}}')",
    "Text": "list_filter({lines}, lambda v: v <> '')",
    "Paragraph": "list_filter(list_transform(regexp_split_to_array({x}, '\n\n+'), lambda v: trim(v, chr(10))), lambda v: v <> '')",
    "Sentence": r"regexp_extract_all({x}, '[^.!?\n]+[.!?]*')",
    "Punctuation": "list_filter(string_split({x}, ''), lambda v: v IN ('.', ',', ';', ':', '!', '?'))",
    "Whitespace": r"regexp_extract_all({x}, '[ \t\n\r]+')",
    "Word": r"regexp_extract_all({x}, '\p{{L}}+')",
    "Text Formatting": "list_filter(regexp_extract_all({x}, chr(39) || '+'), lambda v: length(v) BETWEEN 2 AND 5)",
    "ExternalLink": r"regexp_extract_all({x}, 'https?://[^\s\[\]<>|{{}}]+')",
    "HTMLEntity": "regexp_extract_all({x}, '&#?[A-Za-z0-9]+;')",
}


def _markup_lists() -> str:
    both = lambda rule: ", ".join(
        f"{rule.format(x=x, lines=_LINES_OF.format(x=x)).replace(chr(92) * 2, chr(92))} AS {n}" for x, n in (("parent_text", "o"), ("revision_text", "n"))
    )
    plain = " UNION ALL ".join(
        f"SELECT revision_id, '{kind}' AS type, {both(rule)} FROM ch" for kind, rule in _MARKUP_RULES.items() if kind != "Link"
    )
    own = lambda kind: "[" + ", ".join(f"'{lang}:{alias.lower()}'" for lang, alias, of in LINK_ALIASES if of == kind) + "]"
    link_type = f"""CASE WHEN {_PREFIX} = 'category' OR list_contains({own('Category')}, concat(wiki_db[:2], ':', {_PREFIX})) THEN 'Category'
      WHEN {_PREFIX} IN ('file', 'image', 'media') OR list_contains({own('Media')}, concat(wiki_db[:2], ':', {_PREFIX})) THEN 'Media' ELSE 'Wikilink' END"""
    links = f"""SELECT revision_id, t AS type, list_filter(o, lambda v: {link_type} = t) AS o, list_filter(n, lambda v: {link_type} = t) AS n
      FROM (SELECT revision_id, wiki_db, {both(_MARKUP_RULES['Link'])} FROM ch), (VALUES ('Category'), ('Media'), ('Wikilink')) k(t)"""
    return f"{plain} UNION ALL {links}"


@query(f"""WITH ch AS MATERIALIZED (SELECT * FROM markup WHERE revision_text <> parent_text), e AS ({_markup_lists()}), {_ACTIONS}
SELECT revision_id, {_ACTION_COLUMNS} FROM a GROUP BY revision_id""")
def edit_action_counts(t: Tables):
    from editlens.operators.revisions import expand_actions

    return expand_actions(elements.edit_action_counts(t.markup, aliases=t.link_aliases)).drop("actions", WIKI)


@query(f"""WITH pp AS MATERIALIZED (SELECT p.page_id AS revision_id, p.html AS revision_text, q.html AS parent_text
  FROM pages p JOIN pages q ON p.page_id = q.page_id + 1 WHERE p.html <> q.html), e AS ({_pattern_lists('pp', HTML_PATTERNS, 1)}), {_ACTIONS}
SELECT revision_id, type, least(gained, lost) AS change, gained - least(gained, lost) AS insert, move, lost - least(gained, lost) AS remove FROM a""")
def element_actions(t: Tables):
    return elements.element_actions(t.page_pairs, HTML_PATTERNS, [ID], group=1)


@query("""SELECT revision_id, wiki_db, coalesce(len(names), 0)::INT AS categories, coalesce(array_to_string(names, '|'), '') AS names FROM (
SELECT revision_id, wiki_db, list_transform(list_filter(regexp_extract_all(revision_text, '\\[\\[[^\\[\\]]*\\]\\]'), lambda v:
  lower(split_part(v[3:], ':', 1)) = 'category' OR (wiki_db IN ('eswiki', 'frwiki') AND lower(split_part(v[3:], ':', 1)) = 'kategorija')),
  lambda v: replace(regexp_replace(v, '^[^:]*:(.*)..$', '\\1'), ',', '')) AS names FROM markup)""")
def extract_categories(t: Tables):
    found = elements.extract_categories(t.markup, "revision_text", t.link_aliases)
    return found.select(ID, WIKI, F.size("categories").alias("categories"), F.array_join("categories", "|").alias("names"))


@query(f"""WITH {_DELTAS} SELECT revision_id, wiki_db, CASE WHEN revision_id IN (SELECT revision_id FROM d) THEN 1 ELSE 0 END AS differs FROM pairs""")
def diff_failure_default(t: Tables):
    lines = diff.line_set_diff(t.pairs).groupBy(*S.KEYS).agg(F.collect_list("line").alias("texts_insert"))
    diffs = lines.select(
        *S.KEYS, "texts_insert", F.array().cast("array<string>").alias("texts_removed"),
        F.array().cast(S.CHANGE_PAIRS).alias("texts_change"),
    )
    filled = diff.diff_or_empty(t.pairs.select(*S.KEYS), diffs)
    return filled.select(*S.KEYS, (F.size("texts_insert") + F.size("texts_removed") + F.size("texts_change") > 0).cast("int").alias("differs"))


# --- fragments ----------------------------------------------------------------------------------

@query("""SELECT 'insert' AS kind, text, NULL AS text_pair FROM (SELECT DISTINCT unnest(texts_insert) AS text FROM edits) WHERE length(text) > 0
UNION ALL SELECT 'remove', text, NULL FROM (SELECT DISTINCT unnest(texts_removed) AS text FROM edits) WHERE length(text) > 0
UNION ALL SELECT 'change', c.before, c.after FROM (SELECT DISTINCT unnest(texts_change) AS c FROM edits) WHERE c.before <> c.after
UNION ALL SELECT DISTINCT 'title', replace(coalesce(page_title, ''), '_', ' '), NULL FROM edits
UNION ALL SELECT DISTINCT 'comment', event_comment, NULL FROM edits WHERE event_comment IS NOT NULL""")
def collect_fragments(t: Tables):
    parts = [Fr.collect_fragments(t.edits, k).select(F.lit(k).alias("kind"), "text", "text_pair") for k in Fr.TEXT_COLUMNS]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


@query("SELECT DISTINCT text, CAST(NULL AS VARCHAR) AS text_pair FROM (SELECT unnest(texts_insert) AS text FROM edits) WHERE length(text) > 0")
def sort_by_length(t: Tables):
    return Fr.sort_by_length(Fr.collect_fragments(t.edits, "insert"))


@query("""SELECT text, round(s_0, 6) AS s_0, round(s_1, 6) AS s_1, round(exp(s_0) / (exp(s_0) + exp(s_1)), 6) AS p_0,
round(exp(s_1) / (exp(s_0) + exp(s_1)), 6) AS p_1 FROM frag""")
def softmax_scores(t: Tables):
    return Fr.softmax_scores(t.frag).select("text", *[R6(c) for c in ("s_0", "s_1", "p_0", "p_1")])


def _features_sql(kind: str, fragment: str) -> str:
    stats = ", ".join(
        f"round(coalesce({'max' if s.endswith('max') else 'avg'}({s[:3]}), -1), 6) AS {kind}_{s}" for s in S.FRAGMENT_STATS
    )
    return f"""WITH p AS (SELECT *, exp(s_0) / (exp(s_0) + exp(s_1)) AS p_0, exp(s_1) / (exp(s_0) + exp(s_1)) AS p_1 FROM frag),
o AS ({fragment})
SELECT e.revision_id, {stats} FROM edits e LEFT JOIN o ON e.revision_id = o.rid LEFT JOIN p ON p.text = o.fragment GROUP BY e.revision_id"""


def _features(df, kind):
    return df.select(ID, *[R6(f"{kind}_{s}") for s in S.FRAGMENT_STATS])


@query(_features_sql("insert", "SELECT revision_id AS rid, unnest(texts_insert) AS fragment FROM edits"))
def insert_features(t: Tables):
    return _features(Fr.insert_features(t.edits, t.frag), "insert")


@query(_features_sql("remove", "SELECT revision_id AS rid, unnest(texts_removed) AS fragment FROM edits"))
def remove_features(t: Tables):
    return _features(Fr.remove_features(t.edits, t.frag), "remove")


@query(_features_sql("change", """SELECT rid, c.before AS fragment FROM (SELECT revision_id AS rid, unnest(texts_change) AS c FROM edits)
WHERE c.before <> c.after"""))
def change_features(t: Tables):
    scores = t.frag.withColumn("text_pair", F.concat("text", F.lit("!")))
    return _features(Fr.change_features(t.edits, scores), "change")


_CONV = ", ".join(
    f"round(coalesce({'max' if s.endswith('max') else 'avg'}({s[:3]}), -1), 6) AS insert_{s}" for s in S.FRAGMENT_STATS
)


@query(f"""WITH p AS (SELECT *, exp(s_0) / (exp(s_0) + exp(s_1)) AS p_0, exp(s_1) / (exp(s_0) + exp(s_1)) AS p_1 FROM frag)
SELECT conv_id AS revision_id, {_CONV} FROM conversations JOIN p USING (text) GROUP BY conv_id""")
def fragment_feature_agg(t: Tables):
    per_conversation = t.table("conversations").groupBy(F.col("conv_id").alias(ID)).agg(F.collect_list("text").alias("texts_insert"))
    return _features(Fr.fragment_features(per_conversation, t.frag, "insert", [ID]), "insert")


@query("""SELECT revision_id, round(coalesce(length(replace(page_title, '_', ' ')), 0) / CAST(10 AS DOUBLE), 6) AS title_s_0,
CAST(1 AS DOUBLE) AS title_p_0 FROM edits WHERE page_title IS NOT NULL
UNION ALL SELECT revision_id, CAST(-1 AS DOUBLE), CAST(-1 AS DOUBLE) FROM edits WHERE page_title IS NULL""")
def title_features(t: Tables):
    titles = Fr.collect_fragments(t.edits, "title").where(F.length("text") > 0)
    scores = titles.withColumn("s_0", F.length("text") / F.lit(10.0))
    return Fr.title_features(t.edits, scores).select(ID, R6("title_s_0"), R6("title_p_0"))


@query("""WITH s AS (SELECT revision_id, CASE WHEN event_comment <> 'x' THEN length(event_comment) / CAST(10 AS DOUBLE) END AS s FROM edits)
SELECT revision_id, round(coalesce(s, -1), 6) AS comment_s_0, round(coalesce(-s, -1), 6) AS comment_s_1,
round(coalesce(exp(s) / (exp(s) + exp(-s)), -1), 6) AS comment_p_0, round(coalesce(exp(-s) / (exp(s) + exp(-s)), -1), 6) AS comment_p_1 FROM s""")
def comment_features(t: Tables):
    comments = Fr.collect_fragments(t.edits, "comment").where("text <> 'x'")
    scores = comments.withColumn("s_0", F.length("text") / F.lit(10.0)).withColumn("s_1", -F.col("s_0"))
    return Fr.comment_features(t.edits, scores).select(ID, *[R6(c) for c in S.COMMENT_FEATURES])


def _balanced_sql(rows: str, columns: str) -> str:
    return f"""WITH r AS ({rows}),
sized AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', '42', lang, revision_id))) AS rn,
  count(*) FILTER (WHERE label = 1) OVER () AS n1 FROM r)
SELECT {columns} FROM sized WHERE label = 1 OR rn <= n1"""


_PLACEHOLDERS = "('N/A', 'NA', 'n/a', 'na', 'None', 'nan', 'N/a')"


@query(_balanced_sql(f"""SELECT texts_removed[1] AS sentence1, {Y} AS label, revision_id, wiki_db AS lang FROM edits
WHERE len(texts_removed) = 1 AND length(texts_removed[1]) > 0 AND texts_removed[1] NOT IN {_PLACEHOLDERS}""", "sentence1, label, revision_id, lang"))
def text_training_set(t: Tables):
    return Fr.text_training_set(t.edits, "remove")


@query(_balanced_sql(f"""SELECT texts_change[1].before AS sentence1, texts_change[1].after AS sentence2, {Y} AS label, revision_id,
wiki_db AS lang FROM edits WHERE len(texts_change) = 1 AND texts_change[1].before <> texts_change[1].after""",
                     "sentence1, sentence2, label, revision_id, lang"))
def text_training_set_changes(t: Tables):
    return Fr.text_training_set(t.edits, "change")


@query(_balanced_sql(f"""SELECT event_comment AS sentence1, {Y} AS label, revision_id, wiki_db AS lang FROM edits
WHERE length(event_comment) > 1 AND event_comment NOT IN {_PLACEHOLDERS} AND event_comment <> 'null'""", "sentence1, label, revision_id, lang"))
def comment_training_set(t: Tables):
    return Fr.comment_training_set(t.edits)


@query(f"""SELECT replace(page_title, '_', ' ') AS page_title, round(avg({Y}), 6) AS label, count(*) AS rev_count, min(wiki_db) AS wikidb
FROM history WHERE page_title IS NOT NULL GROUP BY history.page_title HAVING count(*) >= 5""")
def title_training_set(t: Tables):
    return Fr.title_training_set(t.history).select("page_title", R6("label"), "rev_count", "wikidb")


@query("SELECT round(sqrt(avg((linear_pred - boosted_pred) ** 2)), 6) AS rmse FROM history")
def rmse(t: Tables):
    return M.rmse(t.history, "linear_pred", "boosted_pred").select(R6("rmse"))


@query(f"""WITH c AS (SELECT {Y} AS y, CAST(boosted_pred > linear_pred AS INT) AS p FROM history)
SELECT round(avg(CAST(y = p AS INT)), 6) AS accuracy, round(2 * sum(y * p) / CAST(sum(y) + sum(p) AS DOUBLE), 6) AS f1 FROM c""")
def accuracy_f1_text(t: Tables):
    return M.accuracy_f1_text(t.history, LABEL, "linear_pred", "boosted_pred").select(R6("accuracy"), R6("f1"))
