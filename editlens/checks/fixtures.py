"""Views over the driver's tables that stand in for the wiki tables, in Spark and as SQL for the oracle.

They are row-wise projections (no windows), so they grow with the tables; one wiki holds a third of all rows.
"""

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editlens import schema as S
from editlens.operators import edit_features
from editlens.operators.joins import unpivot_scores

# column → expression, or (Spark expression, DuckDB expression) where the dialects differ
HISTORY = {
    "revision_id": "event_id + 1",
    "wiki_db": "CASE WHEN event_id % 9 < 3 THEN 'enwiki' WHEN event_id % 9 < 5 THEN 'dewiki' "
               "WHEN event_id % 9 < 7 THEN 'frwiki' WHEN event_id % 9 = 7 THEN 'eswiki' ELSE 'simplewiki' END",
    "page_title": "CASE WHEN event_id % 101 <> 0 THEN concat('Page_', get_json_object(props, '$.k')) END",
    "event_user_text_historical": "concat('user', user_id)",
    "user_id": "user_id",
    "event_timestamp": "ts",
    "revision_text_bytes_diff": "CAST(floor(value) AS BIGINT) - 200",
    "revision_is_identity_reverted": "event_type = 'error'",
    "event_user_is_anonymous": "user_id % 3 = 0",
    "is_anonymous": "user_id % 3 = 0",
    "event_user_is_bot_by": "CASE WHEN user_id % 11 = 0 THEN array('name') END",
    "event_user_groups": "CASE user_id % 7 WHEN 0 THEN array('sysop', 'rollbacker') WHEN 1 THEN array('editor') "
                         "WHEN 2 THEN array('autopatrolled', 'uploader') END",
    "revision_tags": "CASE event_type WHEN 'click' THEN array('mobile edit', 'mobile web edit') "
                     "WHEN 'view' THEN array('visualeditor') WHEN 'purchase' THEN array('wikieditor') "
                     "WHEN 'signup' THEN array('mobile edit', 'ios app edit') END",
    "revision_parent_id": "CASE WHEN event_id < 9 OR event_id % 14 = 0 THEN 0 ELSE event_id - 8 END",
    "revision_first_identity_reverting_revision_id": "CASE WHEN event_type = 'error' THEN event_id + 10 END",
    "page_revision_count": "(event_id * 31) % 977 + 1",
    "event_comment": "CASE WHEN event_id % 4 <> 0 THEN concat(event_type, ' by ', user_id) END",
    "event_user_seconds_since_previous_revision": "CASE WHEN event_id % 6 <> 0 THEN (event_id * 7907) % 86400 END",
    "event_entity": "CASE WHEN event_id % 17 = 0 THEN 'page' ELSE 'revision' END",
    "page_namespace": "CASE WHEN event_id % 19 = 0 THEN 1 ELSE 0 END",
    "snapshot": "CASE WHEN event_id % 23 = 0 THEN '2022-06' ELSE '2022-07' END",
    "country": "CASE WHEN user_id % 30 < 27 THEN concat('C', user_id % 30) END",
    "nation_key": "user_id % 30",
    "address": "(user_id * 1000003) % 65536",
    "is_balanced": "CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END",
    "incumbent_pred": "CASE WHEN event_id % 13 <> 0 THEN value / 500 END",
    "linear_pred": "CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000",
    "boosted_pred": "(CASE WHEN event_type = 'error' THEN 300 ELSE 0 END + CAST((event_id * 104729) % 700 AS DOUBLE)) / 1000",
}

PAIRS = {
    "revision_id": "doc_id + 1",
    "wiki_db": "concat(lang, 'wiki')",
    "source": "source",
    "parent_text": "text",
    "revision_text": "CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN replace(replace(text, ' the ', ' teh '), ' la ', ' le ') "
                     "WHEN 2 THEN concat(text, chr(10), 'added line about ', source, '.') "
                     "ELSE replace(text, '.', concat('.', chr(10))) END",
}

# Documents as pages with every kind of markup, and an edit of a kind per page.
MARKUP_PAGES = {
    "revision_id": "doc_id + 1",
    "wiki_db": "concat(lang, 'wiki')",
    "source": "source",
    "edit": "doc_id % 10",
    "parent_text": "concat('== About ', source, ' ==', chr(10), '{{Infobox|name=', source, '}} {{{size|', doc_id % 7, '}}}', chr(10), "
                   "repeat(chr(39), 3), 'Bold', repeat(chr(39), 3), ' [[', source, ' town|label]] [[Category:', lang, ' places]] ', "
                   "'[[File:map_', doc_id % 5, '.png|thumb]] [[Kategorija:', source, ']]', chr(10), "
                   "'* first ', source, chr(10), '* second point', chr(10), '# third', chr(10), coalesce(text, ''), chr(10), "
                   "'<!-- checked ', doc_id % 3, ' --> <ref name=a>Book of ', source, '</ref><ref name=b/> &amp; https://example.org/', source, chr(10), "
                   "'<gallery>', chr(10), 'a.png', chr(10), '</gallery>', chr(10), '{|', chr(10), '! head', chr(10), '| cell ', doc_id % 3, chr(10), '|}', "
                   "chr(10), 'one two three four five')",
}
MARKUP = {
    "revision_id": "revision_id",
    "wiki_db": "wiki_db",
    "source": "source",
    "parent_text": "parent_text",
    "revision_text": "CASE edit WHEN 1 THEN replace(replace(parent_text, '== About ', '=== History of '), ' the ', ' teh ') "
                     "WHEN 2 THEN replace(replace(parent_text, '{{Infobox|', '{{Box|other={{{x}}}|'), '{{{size|', '{{{length|') "
                     "WHEN 3 THEN replace(replace(parent_text, '<ref name=b/>', ''), ' checked ', ' seen again ') "
                     "WHEN 0 THEN CASE WHEN revision_id % 20 = 1 THEN replace(parent_text, '>Book of ', ' page=2>Books. On ') ELSE parent_text END "
                     "WHEN 4 THEN replace(replace(replace(parent_text, '[[Category:', '[[KATEGORIJA:about '), '[[File:', '[[Datei:'), ' town|', ' city|') "
                     "WHEN 5 THEN replace(parent_text, concat('* first ', source, chr(10), '* second point', chr(10), '# third', chr(10)), "
                     "concat('* second point', chr(10), '# third', chr(10), '* first ', source, chr(10))) "
                     "WHEN 6 THEN replace(replace(replace(parent_text, 'a.png', 'a.png|caption'), '| cell ', concat('| new cell', chr(10), '| cell ')), '&amp;', '&nbsp; &lt;') "
                     "WHEN 7 THEN replace(replace(parent_text, '. ', concat('.', chr(10), chr(10))), 'https://', 'http://') "
                     "WHEN 8 THEN replace(replace(parent_text, repeat(chr(39), 3), repeat(chr(39), 2)), 'one two three four five', 'two three four five one') "
                     "ELSE concat(parent_text, chr(10), '[[Category:', source, ']] and {{stub}}! [[Datei:z.png]] <ref>new</ref>') END",
}

EDITS = {
    "revision_id": "conv_id * 1000 + turn + 1",
    "wiki_db": "CASE conv_id % 3 WHEN 0 THEN 'enwiki' WHEN 1 THEN 'dewiki' ELSE 'frwiki' END",
    "page_title": "CASE WHEN conv_id % 10 <> 9 THEN concat('Talk_about_', conv_id % 20) END",
    "event_comment": "CASE WHEN conv_id % 10 = 3 THEN 'N/A' WHEN conv_id % 10 = 4 THEN 'x' "
                     "WHEN turn % 4 <> 3 THEN concat(role, ' ', length(text)) END",
    "revision_is_identity_reverted": "length(text) % 3 = 0",
    "is_anonymous": "conv_id % 2 = 0",
    "is_text_train": "CASE WHEN conv_id % 5 < 3 THEN 1 ELSE 0 END",
    "texts_insert": "CASE turn % 3 WHEN 0 THEN array(text) WHEN 1 THEN array(text, role, text, '') END",
    "texts_removed": "CASE WHEN turn % 2 = 0 THEN array(text) WHEN conv_id % 4 = 0 THEN array('N/A') ELSE array('', role) END",
    "texts_change": (
        "CASE turn % 3 WHEN 0 THEN array(named_struct('before', text, 'after', concat(text, '!'))) "
        "WHEN 1 THEN array(named_struct('before', text, 'after', text)) END",
        "CASE turn % 3 WHEN 0 THEN [{'before': text, 'after': concat(text, '!')}] "
        "WHEN 1 THEN [{'before': text, 'after': text}] END",
    ),
}

# Language, prefix of a link, type of the link.
LINK_ALIASES = [
    ("de", "Kategorie", "Category"), ("de", "Datei", "Media"), ("es", "Kategorija", "Category"), ("es", "Categoría", "Category"),
    ("fr", "Kategorija", "Category"), ("fr", "Datei", "Media"),
]

IP_BLOCKS = {
    "ip_start": "CAST(n_nationkey AS BIGINT) * 2621",
    "ip_end": "CAST(n_nationkey AS BIGINT) * 2621 + 2000",
    "country_name": "n_name",
}

FRAGMENT_SCORES = {
    "s_0": "(length(text) % 17) / CAST(8 AS DOUBLE) - 1",
    "s_1": "1 - (length(text) % 23) / CAST(11 AS DOUBLE)",
}

MODELS = {"incumbent_pred": "incumbent", "linear_pred": "linear", "boosted_pred": "boosted"}

HTML_PATTERNS = {
    "Wikilink": r'<a href="([^"]*)"',
    "Heading": r"<h[1-6]>([^<]*)</h",
    "Comment": r"<!--([^>]*)-->",
    "Text": r"<p>([^<]*)</p>",
    "Reference": r'src="([^"]*)"',
}


def _spark(expressions: dict) -> list[str]:
    return [f"{e if isinstance(e, str) else e[0]} AS {name}" for name, e in expressions.items()]


def _duckdb(expressions: dict, table: str) -> str:
    columns = []
    for name, e in expressions.items():
        text = e if isinstance(e, str) else e[1]
        text = text.replace("array(", "list_value(").replace("get_json_object(", "json_extract_string(")
        columns.append(f"{text} AS {name}")
    return f"SELECT {', '.join(columns)} FROM {table}"


_SCORES = " UNION ALL ".join(
    f"SELECT *, '{name}' AS model, {column} AS score FROM history" for column, name in MODELS.items()
)
_HTML = " UNION ALL ".join(
    f"SELECT page_id, '{kind}' AS type, unnest(regexp_extract_all(html, '{pattern}', 1)) AS value FROM pages"
    for kind, pattern in HTML_PATTERNS.items()
)

def _own_prefixes(kind: str) -> str:
    return ", ".join(f"'{lang}:{alias.lower()}'" for lang, alias, of in LINK_ALIASES if of == kind)


_KNOWN = f"'category', 'file', 'image', 'media', {_own_prefixes('Category')}, {_own_prefixes('Media')}"

# name → (SQL, names of the views it uses)
VIEWS = {
    "history": _duckdb(HISTORY, "events"),
    "scores": _SCORES,
    "pairs": _duckdb(PAIRS, "documents"),
    "markup_pages": _duckdb(MARKUP_PAGES, "documents"),
    "markup": _duckdb(MARKUP, "markup_pages"),
    "page_counts": f"""SELECT revision_id AS page, octet_length(encode(parent_text)) AS revision_text_bytes, length(parent_text) AS text_length,
      len(string_split(parent_text, '<ref')) - 1 AS reference_count, len(list_filter(links, lambda k: k NOT IN ({_KNOWN}))) AS wikilink_count,
      len(list_filter(links, lambda k: k IN ('category', {_own_prefixes('Category')}))) AS category_count,
      len(list_filter(links, lambda k: k IN ('file', 'image', 'media', {_own_prefixes('Media')}))) AS media_count,
      len(list_filter(string_split(parent_text, chr(10)), lambda v: regexp_matches(v, '^=+[^=]+='))) AS heading_count
      FROM (SELECT *, list_transform(string_split(parent_text, '[[')[2:], lambda v: CASE WHEN contains(split_part(v, ']]', 1), ':')
        THEN concat(CASE WHEN list_contains(['category', 'file', 'image', 'media'], lower(split_part(v, ':', 1))) THEN '' ELSE concat(left(wiki_db, 2), ':') END, lower(split_part(v, ':', 1))) ELSE '' END) AS links
      FROM markup_pages WHERE parent_text IS NOT NULL)""",
    "content": "SELECT h.revision_id, h.wiki_db, c.*, (least(text_length / 10000, 1) + least(reference_count / 10, 1) + least(wikilink_count / 20, 1) "
               "+ least(category_count / 5, 1) + least(media_count / 3, 1) + least(heading_count / 5, 1)) / 6 AS quality_score "
               "FROM history h JOIN page_counts c ON c.page = h.revision_id % (SELECT count(*) FROM documents) + 1",
    "wikitext": "SELECT 2 * revision_id AS revision_id, wiki_db, revision_text FROM pairs "
                "UNION ALL SELECT 2 * revision_id - 1, wiki_db, parent_text FROM pairs WHERE revision_id % 10 <> 7",
    "edits": _duckdb(EDITS, "conversations"),
    "frag": f"SELECT DISTINCT text, {FRAGMENT_SCORES['s_0']} AS s_0, {FRAGMENT_SCORES['s_1']} AS s_1 FROM conversations",
    "html_elements": _HTML,
    "ip_blocks": _duckdb(IP_BLOCKS, "nation"),
}


def with_views(sql: str) -> str:
    """Puts the views a query names in front of it."""
    needed: list[str] = []

    def add(text: str) -> None:
        for name, body in VIEWS.items():
            if re.search(rf"\b{name}\b", text) and name not in needed:
                add(body)
                needed.append(name)

    add(sql)
    if not needed:
        return sql
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    body = sql.strip()
    return f"WITH {views}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {views} {body}"


class Tables:
    """The driver's tables and the stand-in views as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def history(self) -> DataFrame:
        return self.table("events").selectExpr(*_spark(HISTORY))

    @cached_property
    def pairs(self) -> DataFrame:
        return self.table("documents").selectExpr(*_spark(PAIRS))

    @cached_property
    def markup(self) -> DataFrame:
        """Documents as pages of wikitext with an edit."""
        return self.table("documents").selectExpr(*_spark(MARKUP_PAGES)).selectExpr(*_spark(MARKUP))

    @cached_property
    def link_aliases(self) -> DataFrame:
        """Link prefixes per language."""
        return self.spark.createDataFrame(LINK_ALIASES, "lang string, alias string, type string")

    @cached_property
    def content(self) -> DataFrame:
        """Counts of the text of every revision of the history: the documents in turn, as pages of wikitext."""
        pages = edit_features.content_counts(self.markup, "parent_text", aliases=self.link_aliases).drop(S.WIKI)
        numbered = pages.withColumnRenamed(S.ID, "__page")
        total = F.broadcast(self.table("documents").agg(F.count("*").alias("__all")))  # one row
        return self.history.select(*S.KEYS).join(total).withColumn("__page", F.pmod(S.ID, "__all") + 1).join(numbered, "__page").drop("__page", "__all")

    @cached_property
    def edits(self) -> DataFrame:
        return self.table("conversations").selectExpr(*_spark(EDITS))

    @cached_property
    def ip_blocks(self) -> DataFrame:
        return self.table("nation").selectExpr(*_spark(IP_BLOCKS))

    @cached_property
    def frag(self) -> DataFrame:
        return self.table("conversations").selectExpr("text", *_spark(FRAGMENT_SCORES)).distinct().withColumn(
            "text_pair", F.lit(None).cast("string")
        )

    @cached_property
    def wikitext(self) -> DataFrame:
        own = self.pairs.selectExpr("2 * revision_id AS revision_id", "wiki_db", "revision_text")
        parent = self.pairs.where("revision_id % 10 <> 7").selectExpr(
            "2 * revision_id - 1 AS revision_id", "wiki_db", "parent_text AS revision_text"
        )
        return own.unionByName(parent)

    @cached_property
    def page_pairs(self) -> DataFrame:
        """Every page as a revision whose parent is the page before it."""
        pages = self.table("pages").select(F.col("page_id").alias(S.ID), F.col("html").alias("revision_text"))
        before = pages.select((F.col(S.ID) + 1).alias(S.ID), F.col("revision_text").alias("parent_text"))
        return pages.join(before, S.ID)

    def scores(self, *columns: str) -> DataFrame:
        """Long scores of the three models with the given history columns."""
        wanted = columns or (S.WIKI, S.LABEL, S.ANONYMOUS)
        return unpivot_scores(self.history, wanted, MODELS)

    @cached_property
    def score_maps(self) -> DataFrame:
        """History rows that have an incumbent score, as the reference system stores it."""
        p = F.col("incumbent_pred")
        entry = F.struct(
            F.when(F.col(S.ID) % 29 != 0, F.array(F.when(p > 0.5, "true").otherwise("false"))).alias("prediction"),
            F.create_map(F.lit("true"), p, F.lit("false"), 1 - p).alias("probability"),
        )
        model = F.when(F.col(S.ID) % 31 == 0, F.lit("goodfaith")).otherwise(F.lit("damaging"))
        return self.history.where(p.isNotNull()).select(
            F.col(S.WIKI).alias("database"), F.col(S.ID).alias("rev_id"), "page_namespace",
            F.when(F.col(S.ID) % 37 == 0, 2021).otherwise(2022).alias("year"), F.create_map(model, entry).alias("scores"),
        )
