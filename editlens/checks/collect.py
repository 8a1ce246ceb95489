"""Queries: scans, files, filters, flags, joins."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from editlens import schema as S
from editlens.checks.fixtures import MODELS, Tables
from editlens.checks.registry import query
from editlens.functions import scores as Sc
from editlens.functions.text import (
    decode_counts, decode_pairs, decode_strings, encode_counts, encode_pairs, encode_strings, language_code,
)
from editlens.operators import diff, edit_features as EF, joins, revisions as R
from editlens.plans.collection import CollectionSettings, filtered_revisions, revert_overview
from editlens.session import work_path
from editlens.sources import files, tables

R6 = lambda c, name: F.round(c, 6).alias(name)
ID, WIKI, LABEL = S.ID, S.WIKI, S.LABEL
REVERTED = "CAST(revision_is_identity_reverted AS INT)"
WEEK = "event_timestamp >= TIMESTAMP '2024-01-08' AND event_timestamp < TIMESTAMP '2024-01-15'"
SMALL = f"revision_id, wiki_db, {REVERTED} AS label"


def _small(df):
    return df.select(ID, WIKI, F.col(LABEL).cast("int").alias("label"))


# --- flagship -----------------------------------------------------------------------------------

_JOINED = """
joined AS (
  SELECT t1.*, t2.revision_is_identity_reverted AS rr, t2.event_user_groups AS rg
  FROM history t1 LEFT JOIN history t2
    ON t1.wiki_db = t2.wiki_db AND t1.revision_first_identity_reverting_revision_id = t2.revision_id)
"""
_FILTERED = "NOT coalesce(rr, false) AND coalesce(len(event_user_is_bot_by), 0) = 0 AND revision_parent_id <> 0"
_TRUSTED = "coalesce(list_has_any(rg, ['sysop','oversight','editor','rollbacker','checkuser','abusefilter','bureaucrat']), false)"


@query(f"""WITH {_JOINED}
SELECT wiki_db, count(*) AS row_count, round(avg({REVERTED}), 6) AS revert_rate,
  round(avg(CAST({_TRUSTED} AS INT)), 6) AS trusted_rate
FROM joined WHERE {_FILTERED} GROUP BY wiki_db""")
def revert_overview_by_wiki(t: Tables):
    out = revert_overview(t.history)
    return out.select(WIKI, "row_count", R6("revert_rate", "revert_rate"), R6("trusted_rate", "trusted_rate"))


@query(f"""WITH scanned AS (SELECT * FROM history WHERE event_entity = 'revision' AND page_namespace = 0
  AND snapshot = '2022-07' AND event_timestamp >= TIMESTAMP '2024-01-03' AND event_timestamp < TIMESTAMP '2024-01-25'),
joined AS (SELECT t1.*, t2.revision_is_identity_reverted AS rr, t2.event_user_groups AS rg
  FROM scanned t1 LEFT JOIN scanned t2
    ON t1.wiki_db = t2.wiki_db AND t1.revision_first_identity_reverting_revision_id = t2.revision_id),
kept AS (SELECT * FROM joined WHERE {_FILTERED})
SELECT revision_id, wiki_db, {REVERTED} AS label, CAST({_TRUSTED} AS INT) AS trusted,
  CAST(coalesce(list_contains(revision_tags, 'mobile edit'), false) AS INT) AS is_mobile_edit
FROM kept""")
def collect_filtered_revisions(t: Tables):
    settings = CollectionSettings(start="2024-01-03", end="2024-01-25", drop_revert_wars=True)
    return filtered_revisions(t.history, settings).select(
        ID, WIKI, F.col(LABEL).alias("label"), F.col("is_reverted_by_good_user").alias("trusted"), "is_mobile_edit"
    )


# --- scans, sources, sinks ----------------------------------------------------------------------

@query("""SELECT revision_id, wiki_db, page_title, revision_parent_id FROM history
WHERE event_entity = 'revision' AND page_namespace = 0 AND snapshot = '2022-07' AND wiki_db = 'enwiki'
  AND event_timestamp >= TIMESTAMP '2024-01-05' AND event_timestamp < TIMESTAMP '2024-01-20'""")
def scan_history(t: Tables):
    rows = tables.scan_history(t.history, "2022-07", "2024-01-05", "2024-01-20", ["enwiki"])
    return rows.select(ID, WIKI, "page_title", S.PARENT)


@query("""SELECT revision_id, wiki_db, md5(revision_text) AS digest FROM wikitext
WHERE revision_id % 5 <> 0 AND revision_id % 7 <> 0 AND wiki_db = 'enwiki'""")
def scan_wikitext(t: Tables):
    table = t.wikitext.withColumns({
        "snapshot": F.when(F.col(ID) % 5 == 0, "2022-10").otherwise("2022-11"),
        "page_namespace": F.when(F.col(ID) % 7 == 0, 1).otherwise(0),
    })
    return tables.scan_wikitext(table, "2022-11", ["enwiki"]).select(ID, WIKI, F.md5("revision_text").alias("digest"))


@query("""SELECT revision_id, wiki_db, CASE WHEN revision_id % 31 <> 0 THEN 1 ELSE 0 END AS entries FROM history
WHERE incumbent_pred IS NOT NULL AND page_namespace = 0 AND revision_id % 37 <> 0""")
def scan_reference_scores(t: Tables):
    rows = tables.scan_reference_scores(t.score_maps, 2022, "damaging")
    return rows.select(ID, WIKI, F.size("scores").alias("entries"))


@query(f"SELECT {SMALL} FROM history")
def write_parquet(t: Tables):
    path = work_path(t.spark, "history")
    files.write_parquet(_small(t.history), path)
    return t.spark.read.parquet(path).select(ID, WIKI, "label")


@query(f"SELECT {SMALL} FROM history WHERE wiki_db = 'dewiki'")
def read_parquet(t: Tables):
    path = work_path(t.spark, "history")
    rows = _small(t.history)
    files.write_parquet(rows, path)
    return files.read_parquet(t.spark, path, rows.schema).where(F.col(WIKI) == "dewiki").select(ID, WIKI, "label")


@query(f"SELECT {SMALL} FROM history")
def cached_scan(t: Tables):
    path = work_path(t.spark, "scan")
    files.cached_scan(t.spark, path, lambda: _small(t.history))
    return files.cached_scan(t.spark, path, lambda: _small(t.history).limit(0))


_CSV = T.StructType([
    T.StructField(ID, T.LongType()), T.StructField(WIKI, T.StringType()), T.StructField("text", T.StringType())
])


@query("SELECT revision_id, wiki_db, md5(revision_text) AS digest FROM pairs")
def read_csv_dataset(t: Tables):
    path = work_path(t.spark, "texts")
    files.write_csv(t.pairs.select(F.col("revision_text").alias("text"), "source", WIKI, ID), path)  # another order
    read = files.read_csv_dataset(t.spark, path, _CSV)
    return read.select(ID, WIKI, F.md5("text").alias("digest"))


@query("SELECT revision_id, wiki_db, event_comment AS text FROM history")
def read_many_union(t: Tables):
    path = work_path(t.spark, "languages")
    rows = t.history.select(ID, WIKI, F.col("event_comment").alias("text"), F.replace(WIKI, F.lit("wiki"), F.lit("")).alias("code"))
    files.write_csv(rows, path, ["code"])
    return files.read_many_union(t.spark, path + "/code={}", ["en", "de", "fr", "es", "simple"], _CSV)


@query("SELECT wiki_db, count(*) AS row_count, sum(revision_id)::BIGINT AS id_sum FROM history GROUP BY wiki_db")
def write_csv(t: Tables):
    path = work_path(t.spark, "csv")
    files.write_csv(t.history.select(ID, WIKI, F.col("event_comment").alias("text")), path)
    read = files.read_csv_dataset(t.spark, path, _CSV)
    return read.groupBy(WIKI).agg(F.count(F.lit(1)).alias("row_count"), F.sum(ID).alias("id_sum"))


@query("SELECT wiki_db, revision_id, round(linear_pred, 6) AS predict_score FROM history")
def write_scores(t: Tables):
    path = work_path(t.spark, "scores")
    files.write_scores(t.history.withColumn("predict_score", F.col("linear_pred")), path, "csv")
    read = t.spark.read.options(**files.CSV_OPTIONS).schema(S.SCORES_CSV).csv(path)
    return read.select(WIKI, ID, R6("predict_score", "predict_score"))


@query("SELECT n_nationkey, n_name FROM nation")
def load_dimension(t: Tables):
    return files.load_dimension(t.spark, f"{t.folder}/nation.parquet", ["n_nationkey", "n_name"])


# --- projections and filters --------------------------------------------------------------------

@query("SELECT wiki_db, revision_id, page_title, event_comment, revision_text_bytes_diff, revision_parent_id FROM history")
def project_columns(t: Tables):
    return t.history.select(WIKI, ID, "page_title", "event_comment", "revision_text_bytes_diff", S.PARENT)


@query(f"SELECT {SMALL} FROM history WHERE {WEEK}")
def filter_time_range(t: Tables):
    return _small(R.filter_time_range(t.history, "2024-01-08", "2024-01-15"))


@query(f"SELECT revision_id, {REVERTED} AS revision_is_identity_reverted FROM history")
def cast_label(t: Tables):
    return R.cast_label(t.history).select(ID, LABEL)


@query(f"""WITH {_JOINED}
SELECT revision_id, wiki_db, coalesce(rr, false) AS reverting_revision_is_reverted_revision FROM joined""")
def fill_null_flag(t: Tables):
    return R.fill_null_flag(R.join_reverting_revision(t.history)).select(ID, WIKI, S.REVERTER_REVERTED)


@query(f"WITH {_JOINED} SELECT {SMALL} FROM joined WHERE NOT coalesce(rr, false)")
def filter_revert_wars(t: Tables):
    return _small(R.filter_revert_wars(R.join_reverting_revision(t.history)))


@query(f"SELECT {SMALL} FROM history WHERE coalesce(len(event_user_is_bot_by), 0) = 0")
def filter_bots(t: Tables):
    return _small(R.filter_bots(t.history))


@query(f"SELECT {SMALL} FROM history WHERE revision_parent_id <> 0")
def filter_new_pages(t: Tables):
    return _small(R.filter_new_pages(t.history))


@query(f"SELECT {SMALL} FROM history WHERE event_user_is_anonymous")
def filter_anonymous(t: Tables):
    return _small(R.filter_anonymous(t.history))


@query("""SELECT p.revision_id, p.wiki_db FROM pairs p LEFT JOIN labels l ON l.doc_id = p.revision_id - 1
WHERE l.quality IS NOT NULL AND p.revision_text IS NOT NULL""")
def filter_both_texts(t: Tables):
    labels = t.table("labels").select((F.col("doc_id") + 1).alias(ID), "quality")
    own = t.pairs.join(labels, ID, "left").withColumn("parent_text", F.when(F.col("quality").isNotNull(), F.col("parent_text")))
    return R.filter_both_texts(own).select(ID, WIKI)


@query("SELECT revision_id, wiki_db FROM edits WHERE is_text_train = 0")
def filter_split(t: Tables):
    return R.filter_split(t.edits, text_train=False).select(ID, WIKI)


@query("""SELECT revision_id, wiki_db, event_comment FROM edits WHERE event_comment IS NOT NULL
AND event_comment NOT IN ('N/A', 'NA', 'n/a', 'na', 'None', 'nan', 'N/a')""")
def filter_placeholder_text(t: Tables):
    return R.filter_placeholder_text(t.edits, ["event_comment"]).select(ID, WIKI, "event_comment")


@query("SELECT revision_id, wiki_db, replace(coalesce(page_title, ''), '_', ' ') AS page_title FROM history")
def normalize_title(t: Tables):
    return R.normalize_title(t.history).select(ID, WIKI, "page_title")


@query("SELECT substr(wiki_db, 1, 2) AS code, count(*) AS row_count FROM history GROUP BY 1")
def language_code_counts(t: Tables):
    return t.history.groupBy(language_code(F.col(WIKI)).alias("code")).agg(F.count(F.lit(1)).alias("row_count"))


@query("SELECT revision_id, substr(wiki_db, 1, 2) AS code FROM history", name="language_code")
def _language_code(t: Tables):
    return t.history.select(ID, language_code(F.col(WIKI)).alias("code"))


@query("""SELECT revision_id, round(linear_pred, 6) AS bert_insert_s0_max, round(boosted_pred, 6) AS bert_title_score,
revision_text_bytes_diff AS "change_Table Element" FROM history""")
def rename_features(t: Tables):
    rows = t.history.select(
        ID, R6("linear_pred", "insert_s_0_max"), R6("boosted_pred", "title_s_0"),
        F.col("revision_text_bytes_diff").alias("Table Element_change"),
    )
    return R.rename_features(rows)


@query("""SELECT revision_id, round(coalesce(incumbent_pred, -1), 6) AS incumbent_pred,
coalesce(event_user_seconds_since_previous_revision, -1) AS event_user_seconds_since_previous_revision,
coalesce(country, '-1') AS country FROM history""")
def fill_missing_features(t: Tables):
    columns = ["incumbent_pred", "event_user_seconds_since_previous_revision", "country"]
    filled = R.fill_missing_features(t.history, columns)
    return filled.select(ID, R6("incumbent_pred", "incumbent_pred"), *columns[1:])


@query(f"SELECT {SMALL} FROM history WHERE incumbent_pred IS NOT NULL AND incumbent_pred <> -1 AND linear_pred <> -1")
def filter_scored(t: Tables):
    return _small(R.filter_scored(t.history, ["incumbent_pred", "linear_pred"]))


@query("""SELECT revision_id, wiki_db, 'balanced' AS slice FROM history WHERE is_balanced = 1
UNION ALL SELECT revision_id, wiki_db, 'anonymous' FROM history WHERE is_anonymous
UNION ALL SELECT revision_id, wiki_db, 'wiki' FROM history WHERE wiki_db = 'eswiki'""")
def filter_slice(t: Tables):
    parts = [R.filter_slice(t.history, n, "eswiki").select(ID, WIKI, F.lit(n).alias("slice")) for n in ("balanced", "anonymous", "wiki")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""SELECT h.revision_id, h.wiki_db, h.user_id, round(h.linear_pred, 6) AS linear_pred, e.groups_n
FROM history h JOIN (SELECT revision_id, len(event_user_groups) AS groups_n FROM history WHERE event_user_groups IS NOT NULL) e
USING (revision_id)""")
def drop_incomplete(t: Tables):
    extra = t.history.where("event_user_groups IS NOT NULL").select(
        ID, F.size("event_user_groups").cast("long").alias("groups_n"), (-F.col("linear_pred")).alias("linear_pred")
    )
    rows = t.history.select(ID, WIKI, "user_id", R6("linear_pred", "linear_pred"))
    return R.drop_incomplete(rows, extra, [ID], ["groups_n"])


@query("""SELECT revision_id, wiki_db,
CASE WHEN revision_id % 31 <> 0 AND revision_id % 29 <> 0 THEN incumbent_pred > 0.5 END AS pred,
CASE WHEN revision_id % 31 <> 0 THEN round(incumbent_pred, 6) END AS prob
FROM history WHERE incumbent_pred IS NOT NULL""")
def recode_prediction(t: Tables):
    return t.score_maps.select(
        F.col("rev_id").alias(ID), F.col("database").alias(WIKI),
        Sc.recoded_prediction(F.col("scores")).alias("pred"), R6(Sc.recoded_probability(F.col("scores")), "prob"),
    )


@query("SELECT revision_id, CAST(day(event_timestamp) AS INT) AS day FROM history")
def extract_day(t: Tables):
    return t.history.select(ID, F.dayofmonth(S.TIMESTAMP).alias("day"))


# --- flags --------------------------------------------------------------------------------------

@query(f"WITH {_JOINED} SELECT revision_id, wiki_db, CAST({_TRUSTED} AS INT) AS is_reverted_by_good_user FROM joined")
def flag_trusted_reverter(t: Tables):
    return R.flag_trusted_reverter(R.join_reverting_revision(t.history)).select(ID, WIKI, "is_reverted_by_good_user")


@query("SELECT revision_id, " + ", ".join(
    f"CAST(coalesce(list_contains(revision_tags, '{tag}'), false) AS INT) AS {name}"
    for name, tag in zip(S.TAG_FLAGS, S.EDIT_TAGS)) + " FROM history")
def flag_tags(t: Tables):
    return R.flag_tags(t.history).select(ID, *S.TAG_FLAGS)


@query("SELECT revision_id, wiki_db, is_anonymous, " + ", ".join(
    f"""coalesce(list_contains(event_user_groups, '{g}'), false) AS "{n}" """
    for n, g in zip(S.GROUP_FLAGS, S.USER_GROUPS)) + " FROM history")
def flag_user_groups(t: Tables):
    return R.flag_user_groups(t.history)


@query("""SELECT revision_id, coalesce(len(texts_removed), 0) > 0 OR coalesce(len(texts_insert), 0) > 0
OR coalesce(len(texts_change), 0) > 0 AS text_changes_found FROM edits""")
def flag_text_change(t: Tables):
    return R.flag_text_change(t.edits).select(ID, "text_changes_found")


@query("""SELECT revision_id, incumbent_pred IS NOT NULL AND revision_id % 3 <> 0 AS is_scored,
event_comment IS NOT NULL AS is_comment_exist,
event_user_seconds_since_previous_revision IS NOT NULL AS has_seconds FROM history""")
def flag_presence(t: Tables):
    scored = t.history.withColumn("incumbent_pred", F.when(F.col(ID) % 3 == 0, F.lit(-1.0)).otherwise(F.col("incumbent_pred")))
    names = {
        "is_scored": "incumbent_pred", "is_comment_exist": "event_comment",
        "has_seconds": "event_user_seconds_since_previous_revision",
    }
    return R.flag_presence(scored, names).select(ID, *names)


@query("""SELECT doc_id AS revision_id, len(parts) AS n_texts, md5(array_to_string(parts, '|')) AS digest,
2 AS n_pairs, md5(concat(parts[1], '>', source)) AS pair_digest, len(parts) AS n_count
FROM (SELECT *, string_split(text, chr(10)) AS parts FROM documents)""")
def decode_list_columns(t: Tables):
    docs = t.table("documents").withColumn("parts", F.split("text", "\n"))
    pair = F.struct(F.col("parts")[0].alias("before"), F.col("source").alias("after"))
    written = docs.select(
        F.col("doc_id").alias(ID), encode_strings(F.col("parts")).alias("texts_insert"),
        encode_pairs(F.array(pair, pair)).alias("texts_change"),
        encode_counts(F.create_map(F.lit("insert_Text"), F.size("parts"))).alias("actions"),
    )
    texts, pairs = decode_strings(F.col("texts_insert")), decode_pairs(F.col("texts_change"))
    decoded = written.select(ID, texts.alias("t"), pairs.alias("p"), decode_counts(F.col("actions")).alias("a"))
    return decoded.select(
        ID, F.size("t").cast("long").alias("n_texts"), F.md5(F.array_join("t", "|")).alias("digest"),
        F.size("p").alias("n_pairs"), F.md5(F.concat(F.col("p")[1]["before"], F.lit(">"), F.col("p")[1]["after"])).alias("pair_digest"),
        F.col("a")["insert_Text"].cast("long").alias("n_count"),
    )


@query("SELECT revision_id, " + ", ".join(
    f"""{'CAST(revision_id % 7 AS INT)' if n == 'insert_Text' else 'CAST(revision_id % 3 AS INT)' if n == 'move_Table Element' else '0'} AS "{n}" """
    for n in S.ACTION_FEATURES) + " FROM history")
def expand_actions(t: Tables):
    counts = F.create_map(
        F.lit("insert_Text"), (F.col(ID) % 7).cast("int"), F.lit("move_Table Element"), (F.col(ID) % 3).cast("int")
    )
    return R.expand_actions(t.history.select(ID, counts.alias("actions"))).drop("actions")


_COUNTS = ("text_length", "reference_count", "wikilink_count", "category_count", "media_count", "heading_count")
_RANGE = "CAST(least(floor({0}.quality_score * 6 + 1e-9), 5) AS BIGINT)"
EDIT_FEATURES_SQL = f"""SELECT h.revision_id, h.wiki_db, coalesce(array_to_string(event_user_groups, ','), '') AS user_groups,
CASE WHEN page_title IS NOT NULL THEN s - lag(s) OVER (PARTITION BY h.wiki_db, page_title ORDER BY s, h.revision_id) END AS page_seconds_since_previous_revision,
count(*) OVER (PARTITION BY h.wiki_db, event_user_text_historical ORDER BY s, h.revision_id) AS user_revision_count,
s - min(s) OVER (PARTITION BY h.wiki_db, event_user_text_historical) AS user_age,
CASE WHEN page_title IS NOT NULL THEN s - min(s) OVER (PARTITION BY h.wiki_db, page_title) END AS page_age,
event_user_is_anonymous AS user_is_anonymous, o.revision_text_bytes, revision_text_bytes_diff, event_comment IS NOT NULL AS has_comment,
round(o.quality_score, 6) AS quality_score, round(p.quality_score, 6) AS parent_quality_score, round(o.quality_score - p.quality_score, 6) AS quality_change,
{_RANGE.format('o')} - {_RANGE.format('p')} AS quality_change_range, {_RANGE.format('o')} AS quality_range,
{', '.join(f'o.{c}, p.{c} AS parent_{c}' for c in _COUNTS)}
FROM (SELECT *, epoch_us(event_timestamp) // 1000000 AS s FROM history) h LEFT JOIN content o ON o.revision_id = h.revision_id AND o.wiki_db = h.wiki_db
LEFT JOIN content p ON p.revision_id = h.revision_parent_id AND p.wiki_db = h.wiki_db"""


@query(EDIT_FEATURES_SQL)
def edit_features(t: Tables):
    rows = EF.edit_features(t.history, t.content)
    return rows.select(*S.KEYS, *[R6(c, c) if "quality_" in c and "range" not in c else F.col(c) for c in S.EXTRA_FEATURES])


_STRUCT = "user_groups string, has_comment boolean, user_is_anonymous boolean, quality_score double, parent_quality_score double, quality_change double"
_LONGS = [c for c in S.EXTRA_FEATURES if c not in _STRUCT.replace(",", "").split()]


@query(f"""WITH f AS ({EDIT_FEATURES_SQL}) SELECT h.revision_id, h.wiki_db, {', '.join(f'f.{c}' for c in S.EXTRA_FEATURES)}
FROM history h LEFT JOIN f ON f.revision_id = h.revision_id AND f.wiki_db = h.wiki_db AND f.page_age IS NOT NULL""")
def expand_struct(t: Tables):
    """Features stored as one nested value per revision of a known page; other revisions have none of them."""
    stored = EF.edit_features(t.history, t.content).where("page_age IS NOT NULL")
    raw = stored.select(*S.KEYS, F.to_json(F.struct(*S.EXTRA_FEATURES)).alias("raw"))
    parsed = raw.select(*S.KEYS, F.from_json("raw", ", ".join([_STRUCT, *(f"{c} long" for c in _LONGS)])).alias("features"))
    wide = t.history.select(*S.KEYS).join(parsed, S.KEYS, "left").select(*S.KEYS, "features.*")
    return wide.select(*S.KEYS, *[R6(c, c) if "quality_" in c and "range" not in c else F.col(c) for c in S.EXTRA_FEATURES])


# --- joins --------------------------------------------------------------------------------------

@query(f"""WITH {_JOINED} SELECT revision_id, wiki_db, rr AS reverting_revision_is_reverted_revision,
array_to_string(rg, ',') AS reverter_groups FROM joined""")
def join_reverting_revision(t: Tables):
    return R.join_reverting_revision(t.history).select(
        ID, WIKI, S.REVERTER_REVERTED, F.array_join(S.REVERTER_GROUPS, ",").alias("reverter_groups")
    )


@query("""SELECT p.revision_id * 2 AS revision_id, p.wiki_db, md5(p.revision_text) AS own, md5(p.parent_text) AS parent
FROM pairs p WHERE p.revision_id % 10 <> 7""")
def join_revision_texts(t: Tables):
    asked = t.pairs.select((F.col(ID) * 2).alias(ID), WIKI).withColumn(S.PARENT, F.col(ID) - 1)
    texts = joins.join_revision_texts(asked, t.wikitext)
    return texts.select(ID, WIKI, F.md5("revision_text").alias("own"), F.md5("parent_text").alias("parent"))


@query("""SELECT h.revision_id, h.wiki_db, round(h.incumbent_pred, 6) AS prob FROM history h
WHERE h.incumbent_pred IS NOT NULL AND h.page_namespace = 0 AND h.revision_id % 37 <> 0 AND h.is_anonymous
AND h.revision_id % 31 <> 0""")
def join_scores_broadcast(t: Tables):
    found = joins.join_wanted(tables.scan_reference_scores(t.score_maps, 2022), t.history.where("is_anonymous"))
    return found.select(ID, WIKI, R6(Sc.recoded_probability(F.col("scores")), "prob")).where("prob IS NOT NULL")


@query("""SELECT revision_id, wiki_db, is_anonymous AS event_user_is_anonymous,
array_to_string(event_user_groups, ',') AS user_groups FROM history WHERE is_balanced = 1""")
def join_user_features(t: Tables):
    found = joins.join_user_features(t.history, t.history.where("is_balanced = 1"))
    return found.select(ID, WIKI, "event_user_is_anonymous", F.array_join("event_user_groups", ",").alias("user_groups"))


@query("""SELECT h.revision_id, h.wiki_db, f.is_anonymous, f.is_sysop, f.is_uploader FROM history h
LEFT JOIN (SELECT revision_id, wiki_db, is_anonymous, coalesce(list_contains(event_user_groups, 'sysop'), false) AS is_sysop,
  coalesce(list_contains(event_user_groups, 'uploader'), false) AS is_uploader FROM history WHERE revision_id % 5 <> 0) f
ON h.revision_id = f.revision_id AND h.wiki_db = f.wiki_db""")
def lookup_user_features(t: Tables):
    features = R.flag_user_groups(t.history.where(F.col(ID) % 5 != 0))
    rows = joins.lookup_user_features(t.history.select(*S.KEYS), features)
    return rows.select(ID, WIKI, "is_anonymous", "is_sysop", "is_uploader")


@query("""SELECT h.revision_id, h.wiki_db, round(coalesce(s.score, -1), 6) AS incumbent FROM history h LEFT JOIN
(SELECT revision_id, wiki_db, CASE WHEN revision_id % 3 = 0 THEN incumbent_pred / 2 ELSE incumbent_pred END AS score
 FROM history WHERE incumbent_pred IS NOT NULL) s
ON h.revision_id = s.revision_id AND h.wiki_db = s.wiki_db""")
def lookup_scores(t: Tables):
    known = t.history.where("incumbent_pred IS NOT NULL")
    first = known.select(*S.KEYS, F.col("incumbent_pred").alias("predict_score"), F.lit(1).alias("version"))
    later = known.where(F.col(ID) % 3 == 0).select(
        *S.KEYS, (F.col("incumbent_pred") / 2).alias("predict_score"), F.lit(2).alias("version")
    )
    rows = joins.lookup_scores(t.history.select(*S.KEYS), first.unionByName(later), "incumbent", order="version")
    return rows.select(ID, WIKI, R6("incumbent", "incumbent"))


@query("""SELECT revision_id, wiki_db, round(incumbent_pred, 6) AS incumbent_pred, round(linear_pred, 6) AS linear_pred,
round(boosted_pred, 6) AS boosted_pred FROM history""")
def join_many_models(t: Tables):
    wide = joins.join_many_models(t.scores(*S.KEYS), list(MODELS.values()))
    return wide.select(ID, WIKI, *[R6(f"{m}_pred", f"{m}_pred") for m in MODELS.values()])


@query("SELECT revision_id, wiki_db, CASE WHEN is_anonymous AND is_balanced = 1 THEN 1 ELSE 0 END AS chosen FROM history")
def semi_anti_flag(t: Tables):
    members = t.history.where("is_anonymous AND is_balanced = 1")
    return joins.semi_anti_flag(t.history.select(*S.KEYS), members, S.KEYS, "chosen").select(ID, WIKI, "chosen")


@query("""SELECT revision_id, country FROM history WHERE country IN (
SELECT country FROM history WHERE country IS NOT NULL GROUP BY country ORDER BY count(*) DESC, country LIMIT 10)""")
def semi_join_topk(t: Tables):
    return joins.semi_join_topk(t.history.select(ID, "country"), "country").select(ID, "country")


@query("SELECT h.revision_id, n.n_name FROM history h LEFT JOIN nation n ON h.nation_key = n.n_nationkey")
def join_dimension(t: Tables):
    nations = t.table("nation").select(F.col("n_nationkey").cast("long").alias("nation_key"), "n_name")
    return joins.join_dimension(t.history.select(ID, "nation_key"), nations, ["nation_key"]).select(ID, "n_name")


@query("""SELECT h.revision_id, h.page_title, coalesce(n.n_name, 'Unknown') AS page_region FROM history h
LEFT JOIN nation n ON h.page_title = concat('Page_', n.n_nationkey)""")
def join_page_region(t: Tables):
    regions = t.table("nation").select(
        F.concat(F.lit("Page_"), F.col("n_nationkey")).alias("page_title"), F.col("n_name").alias("page_region")
    )
    return joins.join_page_region(t.history.select(ID, "page_title"), regions).select(ID, "page_title", "page_region")


@query("""SELECT h.revision_id, h.address, b.country_name FROM history h
LEFT JOIN ip_blocks b ON h.address BETWEEN b.ip_start AND b.ip_end""")
def join_ip_range(t: Tables):
    rows = joins.join_ip_range(t.history.select(ID, "address"), t.ip_blocks, "address", ["country_name"])
    return rows.select(ID, "address", "country_name")


@query()
def pair_sentences(t: Tables):
    pairs = diff.diff_lines(t.pairs).select(*S.KEYS, F.inline("texts_change"))
    return pairs.select(ID, WIKI, "before", "after")


@query("SELECT 'history' AS step, count(*) AS row_count FROM history")
def count_rows(t: Tables):
    return t.history.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit("history").alias("step"), "row_count")


@query(f"""WITH {_JOINED},
steps AS (SELECT NOT coalesce(rr, false) AS a, coalesce(len(event_user_is_bot_by), 0) = 0 AS b,
  revision_parent_id <> 0 AS c, is_anonymous AS d FROM joined)
SELECT 'history' AS step, count(*) AS row_count FROM steps
UNION ALL SELECT 'no_revert_wars', count(*) FROM steps WHERE a
UNION ALL SELECT 'no_bots', count(*) FROM steps WHERE a AND b
UNION ALL SELECT 'no_new_pages', count(*) FROM steps WHERE a AND b AND c
UNION ALL SELECT 'anonymous', count(*) FROM steps WHERE a AND b AND c AND d""")
def filter_funnel(t: Tables):
    return R.filter_funnel(R.join_reverting_revision(t.history), anonymous_only=True)
