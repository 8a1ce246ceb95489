"""Queries: aggregates, dedup, samples and splits, metrics, fairness."""

from pyspark.sql import functions as F

from editlens import schema as S
from editlens.checks.fixtures import MODELS, Tables
from editlens.checks.registry import query
from editlens.functions.hashing import hash_uniform
from editlens.operators import aggregates as A
from editlens.operators import fairness as Fa
from editlens.operators import joins, metrics as M, revisions as R, sampling as Sa, slices as Sl
from editlens.operators.scale import exact_quantiles

ID, WIKI, LABEL, ANON = S.ID, S.WIKI, S.LABEL, S.ANONYMOUS
Y = "CAST(revision_is_identity_reverted AS INT)"
R6 = lambda c, name=None: F.round(c, 6).alias(name or c)
PREDS = list(MODELS)


def _rounded(df, keep, values):
    return df.select(*keep, *[R6(v) for v in values])


# --- aggregates ---------------------------------------------------------------------------------

@query(f"""SELECT round(avg(CAST(t2.revision_is_identity_reverted AS INT)), 6) AS bad_revert_rate
FROM history t1 LEFT JOIN history t2 ON t1.wiki_db = t2.wiki_db
AND t1.revision_first_identity_reverting_revision_id = t2.revision_id WHERE t1.revision_is_identity_reverted""")
def bad_revert_rate(t: Tables):
    return A.bad_revert_rate(R.join_reverting_revision(t.history)).select(R6("bad_revert_rate"))


@query(f"SELECT round(avg({Y}), 6) AS revert_rate FROM history")
def revert_rate(t: Tables):
    return A.revert_rate(t.history).select(R6("revert_rate"))


@query(f"""SELECT wiki_db, count(*) AS row_count, round(avg({Y}), 6) AS revert_rate,
round(avg(CAST(is_anonymous AS INT)), 6) AS anonymous_rate FROM history GROUP BY wiki_db""")
def rate_by_group(t: Tables):
    return _rounded(A.rate_by_group(t.history, [WIKI], anonymous=ANON), [WIKI, "row_count"], ["revert_rate", "anonymous_rate"])


@query(f"""SELECT wiki_db, coalesce(len(texts_insert), 0) > 0 OR coalesce(len(texts_change), 0) > 0
OR coalesce(len(texts_removed), 0) > 0 AS text_changes_found, count(*) AS row_count, round(avg({Y}), 6) AS revert_rate
FROM edits GROUP BY ALL""")
def rate_count_by_two_keys(t: Tables):
    rates = A.rate_by_group(R.flag_text_change(t.edits), [WIKI, "text_changes_found"])
    return _rounded(rates, [WIKI, "text_changes_found", "row_count"], ["revert_rate"])


@query(f"""SELECT page_title, round(avg({Y}), 6) AS label, count(*) AS rev_count, min(wiki_db) AS wikidb
FROM history WHERE page_title IS NOT NULL GROUP BY page_title HAVING count(*) >= 5""")
def title_stats(t: Tables):
    return A.title_stats(t.history).select("page_title", R6("label"), "rev_count", "wikidb")


@query("SELECT wiki_db, count(*) AS row_count FROM history GROUP BY wiki_db")
def value_counts(t: Tables):
    return A.value_counts(t.history, WIKI)


@query("""SELECT country, count(*) AS row_count FROM history WHERE country IS NOT NULL
GROUP BY country ORDER BY row_count DESC, country LIMIT 10""")
def top_k_values(t: Tables):
    return joins.top_k_values(t.history, "country")


@query("""SELECT revision_is_identity_reverted AS label, count(incumbent_pred) AS row_count, round(avg(incumbent_pred), 6) AS mean,
round(stddev(incumbent_pred), 6) AS std, round(min(incumbent_pred), 6) AS min, round(quantile_cont(incumbent_pred, 0.25), 6) AS p25,
round(quantile_cont(incumbent_pred, 0.5), 6) AS p50, round(quantile_cont(incumbent_pred, 0.75), 6) AS p75,
round(max(incumbent_pred), 6) AS max FROM history GROUP BY 1""")
def describe_by_label(t: Tables):
    table = A.describe_by_label(t.history, "incumbent_pred").withColumnRenamed(LABEL, "label")
    return _rounded(table, ["label", "row_count"], ["mean", "std", "min", "p25", "p50", "p75", "max"])


@query("""SELECT round(avg(CAST(incumbent_pred IS NOT NULL AS INT)), 6) AS has_incumbent_pred,
round(avg(CAST(event_user_seconds_since_previous_revision IS NOT NULL AS INT)), 6) AS has_seconds,
round(avg(CAST(incumbent_pred IS NOT NULL OR event_user_seconds_since_previous_revision IS NOT NULL AS INT)), 6) AS has_any
FROM history""")
def coverage_rates(t: Tables):
    rows = t.history.withColumnRenamed("event_user_seconds_since_previous_revision", "seconds")
    return _rounded(A.coverage_rates(rows, ["incumbent_pred", "seconds"]), [], ["has_incumbent_pred", "has_seconds", "has_any"])


_NULLABLE = ["event_comment", "page_title", "incumbent_pred", "country", "event_user_seconds_since_previous_revision"]


@query("WITH rates AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", avg(CAST({c} IS NULL AS INT)) AS rate FROM history""" for c in _NULLABLE) + """)
SELECT "column", round(rate, 6) AS rate FROM rates UNION ALL SELECT 'mean_rate', round(avg(rate), 6) FROM rates""")
def missing_rates(t: Tables):
    return A.missing_rates(t.history, _NULLABLE).select("column", R6("rate"))


@query("""SELECT label, row_count, round(CAST(total AS DOUBLE) / (2 * row_count), 6) AS weight FROM (
SELECT revision_is_identity_reverted AS label, count(*) AS row_count, sum(count(*)) OVER () AS total FROM history GROUP BY 1)""")
def class_weights(t: Tables):
    return A.class_weights(t.history).select(F.col(LABEL).alias("label"), "row_count", R6("weight"))


_CELLS = " UNION ALL ".join(
    f"SELECT '{a}' AS model_a, '{b}' AS model_b, round(corr({a}, {b}), 6) AS corr FROM h"
    for a in PREDS for b in PREDS
)


@query(f"WITH h AS (SELECT * FROM history WHERE incumbent_pred IS NOT NULL) {_CELLS}")
def correlation_matrix(t: Tables):
    return A.correlation_matrix(t.history, PREDS).select("model_a", "model_b", R6("corr"))


@query("""WITH w AS (SELECT page_title, avg(CAST(is_anonymous AS INT)) AS x, avg(boosted_pred) AS y FROM history
WHERE page_title IS NOT NULL GROUP BY page_title),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / CAST(2 AS DOUBLE) AS rx,
rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / CAST(2 AS DOUBLE) AS ry FROM w)
SELECT round(corr(rx, ry), 4) AS rank_corr, count(*) AS n FROM r""")
def rank_correlation(t: Tables):
    rates = t.history.where("page_title IS NOT NULL").groupBy("page_title").agg(
        F.avg(F.col(ANON).cast("int")).alias("x"), F.avg("boosted_pred").alias("y")
    )
    return A.rank_correlation(rates, "x", "y").select(F.round("rank_corr", 4).alias("rank_corr"), "n")


@query("""SELECT round(regr_slope(boosted_pred, linear_pred), 6) AS slope, round(regr_intercept(boosted_pred, linear_pred), 6) AS intercept,
round(regr_r2(boosted_pred, linear_pred), 6) AS r2 FROM history""")
def regression_line(t: Tables):
    return _rounded(A.regression_line(t.history, "linear_pred", "boosted_pred"), [], ["slope", "intercept", "r2"])


@query(f"""SELECT round(avg(CAST(k IN (0, 3) AS INT)), 6) AS all_same, round(avg(CAST(k = 3 AS INT)), 6) AS all_correct,
round(avg(CAST(k > 0 AS INT)), 6) AS any_correct FROM (SELECT CAST((incumbent_pred > 0.5) = revision_is_identity_reverted AS INT)
+ CAST((linear_pred > 0.5) = revision_is_identity_reverted AS INT) + CAST((boosted_pred > 0.5) = revision_is_identity_reverted AS INT) AS k
FROM history WHERE incumbent_pred IS NOT NULL)""")
def agreement_rates(t: Tables):
    rates = M.agreement_rates(R.filter_scored(t.history, PREDS), PREDS)
    return _rounded(rates, [], ["all_same", "all_correct", "any_correct"])


@query(f"""WITH cells AS (SELECT * FROM (SELECT DISTINCT model, wiki_db FROM scores), (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(actual, predicted)),
c AS (SELECT model, wiki_db, {Y} AS actual, CAST(coalesce(score, -1) > 0.5 AS INT) AS predicted, count(*) AS n FROM scores GROUP BY ALL)
SELECT model, wiki_db, actual, predicted, coalesce(n, 0) AS row_count FROM cells LEFT JOIN c USING (model, wiki_db, actual, predicted)""")
def confusion_matrix(t: Tables):
    return M.confusion_matrix(t.scores(), ["model", WIKI])


_RATE_BY = f"count(*) AS row_count, round(avg({Y}), 6) AS revert_rate"


@query(f"""SELECT coalesce(wiki_db, 'all') AS scope, {_RATE_BY} FROM history GROUP BY GROUPING SETS ((), (wiki_db))""")
def rate_grouping_sets(t: Tables):
    return _rounded(Sl.rate_grouping_sets(t.history), ["scope", "row_count"], ["revert_rate"])


# --- sorts, dedup, set operations ---------------------------------------------------------------

@query("SELECT revision_id, page_revision_count FROM history ORDER BY page_revision_count DESC, revision_id LIMIT 30")
def sort_limit_topk(t: Tables):
    return t.history.select(ID, "page_revision_count").orderBy(F.desc("page_revision_count"), ID).limit(30)


@query("SELECT revision_id, wiki_db, revision_text_bytes_diff FROM history")
def dedup_keys(t: Tables):
    rows = t.history.select(ID, WIKI, "revision_text_bytes_diff", F.lit(1).alias("copy"))
    later = rows.withColumns({"revision_text_bytes_diff": F.lit(0).cast("long"), "copy": F.lit(2)})
    return A.dedup_keys(rows.unionByName(later), [ID, WIKI], ["copy"]).drop("copy")


@query("SELECT DISTINCT wiki_db, page_title FROM history")
def distinct_values(t: Tables):
    return t.history.select(WIKI, "page_title").distinct()


@query("""SELECT revision_id, wiki_db, 'history' AS origin FROM history
UNION ALL SELECT revision_id, wiki_db, 'edits' FROM edits""")
def union_all(t: Tables):
    own = t.history.select(ID, WIKI, F.lit("history").alias("origin"))
    return own.unionByName(t.edits.select(F.lit("edits").alias("origin"), ID, WIKI))


# --- samples and splits -------------------------------------------------------------------------

def _hash(*keys):
    return "md5(concat_ws(':', '42', " + ", ".join(keys) + "))"


_SIZES = f"""WITH sized AS (SELECT *, {Y} AS y,
  row_number() OVER (PARTITION BY wiki_db, revision_is_identity_reverted ORDER BY {_hash('revision_id')}) AS rn,
  count(*) FILTER (WHERE revision_is_identity_reverted) OVER (PARTITION BY wiki_db) AS n1,
  count(*) FILTER (WHERE NOT revision_is_identity_reverted) OVER (PARTITION BY wiki_db) AS n0
  FROM {{rows}})"""


@query(f"""SELECT revision_id, wiki_db FROM (SELECT *, row_number() OVER (PARTITION BY wiki_db ORDER BY {_hash('revision_id')}) AS rn
FROM history) WHERE rn <= 1500""")
def sample_cap(t: Tables):
    return Sa.sample_cap(t.history.select(ID, WIKI), 1500)


@query(f"""SELECT revision_id, wiki_db FROM (SELECT *, count(*) OVER (PARTITION BY wiki_db) AS n FROM history)
WHERE CAST('0x' || substr({_hash('revision_id')}, 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) < CAST(1500 AS DOUBLE) / n""")
def sample_cap_bernoulli(t: Tables):
    return Sa.sample_cap(t.history.select(ID, WIKI), 1500, exact=False)


@query(f"""WITH sized AS (SELECT *, {Y} AS y, row_number() OVER (PARTITION BY revision_is_identity_reverted
  ORDER BY {_hash('wiki_db', 'revision_id')}) AS rn, count(*) FILTER (WHERE revision_is_identity_reverted) OVER () AS n1,
  count(*) FILTER (WHERE NOT revision_is_identity_reverted) OVER () AS n0 FROM history)
SELECT revision_id, wiki_db, y AS label FROM sized WHERE rn <= CASE y WHEN 0 THEN least(n0, 1200) ELSE least(n1, least(n0, 1200)) END""")
def sample_cap_by_class(t: Tables):
    rows = Sa.sample_cap_by_class(t.history.select(ID, WIKI, LABEL), 1200)
    return rows.select(ID, WIKI, F.col(LABEL).cast("int").alias("label"))


@query(_SIZES.format(rows="history") + """
SELECT revision_id, wiki_db, CASE WHEN y = 1 OR rn <= n1 THEN 1 ELSE 0 END AS is_balanced FROM sized""")
def balance_flag(t: Tables):
    return Sa.balance_flag(t.history.select(ID, WIKI, LABEL)).select(ID, WIKI, "is_balanced")


@query(_SIZES.format(rows="history") + " SELECT revision_id, wiki_db, y AS label FROM sized WHERE y = 1 OR rn <= n1")
def balance_per_language(t: Tables):
    rows = Sa.balance_per_language(t.history.select(ID, WIKI, LABEL))
    return rows.select(ID, WIKI, F.col(LABEL).cast("int").alias("label"))


@query(_SIZES.format(rows="(SELECT * FROM history WHERE is_anonymous)") + """
SELECT revision_id, wiki_db, y AS label FROM sized WHERE rn <= least(n0, n1)""")
def balance_two_sided(t: Tables):
    rows = Sa.balance_two_sided(t.history.select(ID, WIKI, LABEL, ANON))
    return rows.select(ID, WIKI, F.col(LABEL).cast("int").alias("label"))


@query(f"""WITH sized AS (SELECT *, {Y} AS y, row_number() OVER (PARTITION BY revision_is_identity_reverted
  ORDER BY {_hash('wiki_db', 'revision_id')}) AS rn, count(*) FILTER (WHERE revision_is_identity_reverted) OVER () AS n1 FROM history)
SELECT revision_id, wiki_db AS lang, y AS label FROM sized WHERE y = 1 OR rn <= n1""")
def balance_training_set(t: Tables):
    rows = t.history.select(ID, F.col(WIKI).alias("lang"), F.col(LABEL).cast("int").alias("label"))
    return Sa.balance_training_set(rows)


@query("SELECT revision_id, CASE WHEN event_timestamp < TIMESTAMP '2024-01-21' THEN 'train' ELSE 'test' END AS part FROM history")
def split_by_time(t: Tables):
    return Sa.split_by_time(t.history, "2024-01-21").select(ID, "part")


@query(f"""WITH titles AS (SELECT *, row_number() OVER (PARTITION BY wiki_db ORDER BY {_hash('page_title')}) AS rn,
  count(*) OVER (PARTITION BY wiki_db) AS n FROM (SELECT DISTINCT wiki_db, page_title FROM history WHERE page_title IS NOT NULL))
SELECT h.revision_id, h.wiki_db, CASE WHEN t.rn <= floor(t.n * CAST(0.6 AS DOUBLE)) THEN 1 ELSE 0 END AS is_text_train
FROM history h JOIN titles t ON h.wiki_db = t.wiki_db AND h.page_title = t.page_title""")
def split_by_title(t: Tables):
    rows = t.history.where("page_title IS NOT NULL").select(ID, WIKI, "page_title")
    return Sa.split_by_title(rows).select(ID, WIKI, "is_text_train")


@query(f"""SELECT revision_id, wiki_db, CASE WHEN rn <= ceil(n * CAST(0.1 AS DOUBLE)) THEN 'test' ELSE 'train' END AS part FROM (
SELECT *, row_number() OVER (PARTITION BY revision_is_identity_reverted ORDER BY {_hash('wiki_db', 'revision_id')}) AS rn,
count(*) OVER (PARTITION BY revision_is_identity_reverted) AS n FROM history)""")
def split_stratified(t: Tables):
    return Sa.split_stratified(t.history.select(ID, WIKI, LABEL)).select(ID, WIKI, "part")


@query(f"""SELECT revision_id, wiki_db, CASE WHEN rn <= ceil(n * CAST(0.05 AS DOUBLE)) THEN 'test' ELSE 'train' END AS part FROM (
SELECT *, row_number() OVER (ORDER BY {_hash('wiki_db', 'revision_id')}) AS rn, count(*) OVER () AS n FROM history)""")
def split_random(t: Tables):
    return Sa.split_random(t.history.select(ID, WIKI)).select(ID, WIKI, "part")


@query("""SELECT revision_id, CASE WHEN day(event_timestamp) <= 5 THEN 'train' ELSE 'test' END AS part FROM history
WHERE day(event_timestamp) <= 7""")
def split_by_day(t: Tables):
    return Sa.split_by_day(t.history).select(ID, "part")


# --- metrics ------------------------------------------------------------------------------------

def _long(keys: str, where: str = "true", extra: str = "") -> str:
    """SQL of the score rows of the three models, and of their metrics per group."""
    by = ", ".join(["model", *([keys] if keys else [])])
    return f"""WITH s AS (SELECT *, {Y} AS y, coalesce(score, -1) AS sc FROM scores WHERE {where}),
ranked AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY sc) + (count(*) OVER (PARTITION BY {by}, sc) - 1) / CAST(2 AS DOUBLE) AS r FROM s),
m AS (SELECT {by}, count(*) AS n, sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg,
  sum(CASE WHEN sc > 0.5 THEN y ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN sc > 0.5 THEN 1 - y ELSE 0 END)::BIGINT AS fp,
  sum(CASE WHEN sc > 0.5 THEN 0 ELSE y END)::BIGINT AS fn, sum(CASE WHEN sc > 0.5 THEN 0 ELSE 1 - y END)::BIGINT AS tn,
  sum(CASE WHEN y = 1 THEN r END) AS ranks{extra} FROM ranked GROUP BY {by}),
t AS (SELECT *, round((tp + tn) / CAST(n AS DOUBLE), 6) AS accuracy,
  round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / CAST(tp + fp AS DOUBLE) END, 6) AS precision,
  round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / CAST(tp + fn AS DOUBLE) END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END, 6) AS f1,
  round(n_pos / CAST(n AS DOUBLE), 6) AS revert_rate,
  CASE WHEN n_pos * n_neg > 0 THEN (ranks - CAST(n_pos AS DOUBLE) * (n_pos + 1) / 2) / (CAST(n_pos AS DOUBLE) * n_neg) END AS auc_raw,
  round(auc_raw, 6) AS auc FROM m)"""


_CURVE = f"""WITH c AS (SELECT {{by}}, coalesce(score, -1) AS sc, sum({Y})::BIGINT AS pos, sum(1 - {Y})::BIGINT AS neg FROM scores GROUP BY ALL),
p AS (SELECT *, sum(pos) OVER down AS tp, sum(neg) OVER down AS fp, sum(pos) OVER (PARTITION BY {{by}}) AS all_pos,
  sum(neg) OVER (PARTITION BY {{by}}) AS all_neg FROM c WINDOW down AS (PARTITION BY {{by}} ORDER BY sc DESC)),
k AS (SELECT {{by}}, sc, pos, neg, CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(all_pos AS DOUBLE) AS all_pos,
  CAST(all_neg AS DOUBLE) AS all_neg FROM p)"""


@query(_long("wiki_db") + " SELECT model, wiki_db, n, accuracy, precision, recall, f1 FROM t")
def binary_metrics(t: Tables):
    return _rounded(M.binary_metrics(t.scores(), ["model", WIKI]), ["model", WIKI, "n"], ["accuracy", "precision", "recall", "f1"])


@query(_long("wiki_db") + " SELECT model, wiki_db, n, auc FROM t")
def roc_auc(t: Tables):
    return _rounded(M.roc_auc(t.scores(), ["model", WIKI]), ["model", WIKI, "n"], ["auc"])


@query(f"""SELECT model, round(avg(-({Y} * ln(p) + (1 - {Y}) * ln(1 - p))), 6) AS log_loss FROM (
SELECT *, least(greatest(score, 1e-15), 1 - 1e-15) AS p FROM scores WHERE score IS NOT NULL) GROUP BY model""")
def log_loss(t: Tables):
    return _rounded(M.log_loss(t.scores(), ["model"]), ["model"], ["log_loss"])


@query(_CURVE.format(by="model") + """
SELECT model, round(sc, 6) AS threshold, round(fp / all_neg, 6) AS fpr, round(tp / all_pos, 6) AS tpr FROM k""")
def roc_curve(t: Tables):
    return _rounded(M.roc_curve(t.scores(), ["model"]), ["model"], ["threshold", "fpr", "tpr"])


@query(_CURVE.format(by="model") + """
SELECT model, round(sc, 6) AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / all_pos, 6) AS recall FROM k
UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE) FROM k""")
def pr_curve(t: Tables):
    return _rounded(M.pr_curve(t.scores(), ["model"]), ["model"], ["threshold", "precision", "recall"])


@query(_CURVE.format(by="model, wiki_db") + """,
a AS (SELECT model, wiki_db, tp / all_pos AS rec, tp / (tp + fp) AS prec,
  lag(tp / all_pos, 1, 0) OVER w AS rec0, lag(tp / (tp + fp), 1, 1) OVER w AS prec0 FROM k WINDOW w AS (PARTITION BY model, wiki_db ORDER BY sc DESC))
SELECT model, wiki_db, round(sum((rec - rec0) * (prec + prec0) / 2), 6) AS pr_auc FROM a GROUP BY model, wiki_db""")
def pr_auc(t: Tables):
    return _rounded(M.pr_auc(t.scores(), ["model", WIKI]), ["model", WIKI], ["pr_auc"])


@query(_CURVE.format(by="model, wiki_db") + """
SELECT model, wiki_db, round(arg_max(tp / (tp + fp), sc), 6) AS precision_at_recall FROM k WHERE tp / all_pos > 0.75 GROUP BY model, wiki_db""")
def precision_at_recall(t: Tables):
    return _rounded(M.precision_at_recall(t.scores(), ["model", WIKI]), ["model", WIKI], ["precision_at_recall"])


@query(_CURVE.format(by="model") + """
SELECT model, round(sc, 6) AS threshold, round(max(tp / (tp + fp)) OVER (PARTITION BY model ORDER BY sc), 6) AS precision,
round(tp / all_pos, 6) AS recall FROM k
UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE) FROM k""")
def pr_envelope(t: Tables):
    return _rounded(M.pr_envelope(t.scores(), ["model"]), ["model"], ["threshold", "precision", "recall"])


@query(f"""WITH s AS (SELECT model, {Y} AS y, coalesce(score, -1) AS sc, threshold FROM scores,
  (VALUES {', '.join(f'(CAST({x} AS DOUBLE))' for x in M.SWEEP)}) v(threshold)),
a AS (SELECT model, threshold, count(*) AS total, sum(y)::BIGINT AS reverts, count(*) FILTER (WHERE sc > threshold) AS flagged,
  count(*) FILTER (WHERE sc > threshold AND y = 1) AS hits FROM s GROUP BY ALL)
SELECT model, threshold, total, reverts, flagged, hits, CASE WHEN flagged > 0 THEN round(hits / CAST(flagged AS DOUBLE), 6) END AS precision,
CASE WHEN flagged > 0 THEN round(hits / CAST(reverts AS DOUBLE), 6) END AS recall FROM a""")
def threshold_sweep(t: Tables):
    table = M.threshold_sweep(t.scores(), ["model"])
    return _rounded(table, ["model", "threshold", "total", "reverts", "flagged", "hits"], ["precision", "recall"])


@query(_long("wiki_db", extra=", avg(CAST(is_anonymous AS INT)) AS ar") + """
SELECT model, wiki_db, n, revert_rate, auc, round(ar, 6) AS anonymous_rate, articles
FROM t LEFT JOIN (SELECT (ARRAY['enwiki', 'dewiki', 'frwiki', 'eswiki'])[n_nationkey + 1] AS wiki, (n_nationkey + 1) * 1000000 AS articles
  FROM nation WHERE n_nationkey < 4) ON wiki = wiki_db""")
def metrics_by_wiki(t: Tables):
    named = F.get(F.array(*[F.lit(f"{c}wiki") for c in ("en", "de", "fr", "es")]), F.col("n_nationkey").cast("int"))
    articles = t.table("nation").where("n_nationkey < 4").select(
        named.alias(WIKI), ((F.col("n_nationkey") + 1) * 1000000).alias("articles")
    )
    table = Sl.metrics_by_wiki(t.scores(), articles)
    return _rounded(table, ["model", WIKI, "n", "articles"], ["revert_rate", "auc", "anonymous_rate"])


@query(_long("wiki_db, CAST(day(event_timestamp) AS INT)").replace(
    "PARTITION BY model, wiki_db, CAST(day(event_timestamp) AS INT)", "PARTITION BY model, wiki_db, day(event_timestamp)").replace(
    "SELECT model, wiki_db, CAST(day(event_timestamp) AS INT), count", "SELECT model, wiki_db, CAST(day(event_timestamp) AS INT) AS day, count") + """
SELECT model, wiki_db, day, n, accuracy, auc FROM t""")
def metrics_by_day(t: Tables):
    table = Sl.metrics_by_day(t.scores(WIKI, LABEL, S.TIMESTAMP), [WIKI])
    return _rounded(table, ["model", WIKI, "day", "n"], ["accuracy", "auc"])


@query(_long("has_comment", extra=", count(event_comment) AS samples_count").replace(
    "FROM scores WHERE", ", event_comment IS NOT NULL AS has_comment FROM scores WHERE") + """
SELECT model, has_comment, n, f1, accuracy, auc, samples_count FROM t""")
def metrics_by_group(t: Tables):
    rows = R.flag_presence(t.scores(LABEL, "event_comment"), {"has_comment": "event_comment"})
    table = Sl.metrics_by_group(rows, ["has_comment"], counted="event_comment")
    return _rounded(table, ["model", "has_comment", "n", "samples_count"], ["f1", "accuracy", "auc"])


def _bucket_sql(column: str) -> str:
    edges = ", ".join(f"quantile_cont({column}, CAST({i} AS DOUBLE) / 12) AS e{i}" for i in range(1, 12))
    above = " + ".join(f"CASE WHEN {column} > e{i} THEN 1 ELSE 0 END" for i in range(1, 12))
    return edges, f"CASE WHEN {column} IS NOT NULL THEN 12 - ({above}) END"


_EDGES, _BUCKET = _bucket_sql("event_user_seconds_since_previous_revision")


@query(f"""WITH e AS (SELECT {_EDGES} FROM history)
SELECT revision_id, {_BUCKET} AS bucket FROM history, e""")
def quantile_buckets(t: Tables):
    return Sl.quantile_buckets(t.history, "event_user_seconds_since_previous_revision", "bucket").select(ID, "bucket")


_PEDGES, _PBUCKET = _bucket_sql("page_revision_count")


@query(_long("bucket").replace("WITH s AS (SELECT *,", f"WITH e AS (SELECT {_PEDGES} FROM history), s AS (SELECT *,").replace(
    "FROM scores WHERE", f", {_PBUCKET} AS bucket FROM scores, e WHERE") + " SELECT model, bucket, n, f1, accuracy, auc FROM t")
def metrics_by_quantile(t: Tables):
    table = Sl.metrics_by_quantile(t.scores(LABEL, "page_revision_count"), t.history, "page_revision_count")
    return _rounded(table, ["model", "bucket", "n"], ["f1", "accuracy", "auc"])


@query("""SELECT round(quantile_cont(page_revision_count, 0.1), 6) AS q_0, round(quantile_cont(page_revision_count, 0.5), 6) AS q_1,
round(quantile_cont(page_revision_count, 0.99), 6) AS q_2 FROM history""")
def exact_quantile_values(t: Tables):
    return _rounded(exact_quantiles(t.history, [], "page_revision_count", [0.1, 0.5, 0.99]), [], ["q_0", "q_1", "q_2"])


@query(f"""WITH p AS (SELECT *, 'all' AS population FROM scores UNION ALL SELECT *, 'anonymous' FROM scores WHERE is_anonymous),
r AS (SELECT model, population, {Y} AS y, rank() OVER (PARTITION BY model, population ORDER BY score)
  + (count(*) OVER (PARTITION BY model, population, score) - 1) / CAST(2 AS DOUBLE) AS r FROM p WHERE score IS NOT NULL)
SELECT model, population, count(*) AS n, round((sum(CASE WHEN y = 1 THEN r END) - CAST(sum(y) AS DOUBLE) * (sum(y) + 1) / 2)
  / (CAST(sum(y) AS DOUBLE) * sum(1 - y)), 6) AS auc FROM r GROUP BY model, population""")
def text_model_auc(t: Tables):
    table = M.text_model_auc(t.history, {name: column for column, name in MODELS.items()})
    return _rounded(table, ["model", "population", "n"], ["auc"])


@query(f"""WITH m AS (SELECT wiki_db, count(*) AS n, sum(CASE WHEN is_anonymous THEN {Y} ELSE 0 END)::BIGINT AS tp,
sum(CASE WHEN is_anonymous THEN 1 - {Y} ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN is_anonymous THEN 0 ELSE {Y} END)::BIGINT AS fn,
sum(CASE WHEN is_anonymous THEN 0 ELSE 1 - {Y} END)::BIGINT AS tn FROM history GROUP BY wiki_db)
SELECT wiki_db, n, round((tp + tn) / CAST(n AS DOUBLE), 6) AS accuracy, round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) AS f1,
round((tp / CAST(tp + fn AS DOUBLE) + tn / CAST(tn + fp AS DOUBLE)) / 2, 6) AS auc FROM m""")
def baseline_anonymous(t: Tables):
    return _rounded(M.baseline_anonymous(t.history, [WIKI]), [WIKI, "n"], ["accuracy", "f1", "auc"])


@query(f"""WITH s AS (SELECT {Y} AS y, CAST('0x' || substr({_hash('wiki_db', 'revision_id')}, 1, 8) AS BIGINT) AS sc FROM history),
r AS (SELECT y, rank() OVER (ORDER BY sc) + (count(*) OVER (PARTITION BY sc) - 1) / CAST(2 AS DOUBLE) AS r FROM s)
SELECT count(*) AS n, round((sum(CASE WHEN y = 1 THEN r END) - CAST(sum(y) AS DOUBLE) * (sum(y) + 1) / 2)
  / (CAST(sum(y) AS DOUBLE) * sum(1 - y)), 6) AS auc FROM r""")
def baseline_random(t: Tables):
    return _rounded(M.baseline_random(t.history), ["n"], ["auc"])


_ALL_OR_WIKI = "(SELECT *, 'all' AS scope FROM scores UNION ALL SELECT *, wiki_db FROM scores)"


@query(_long("scope").replace("FROM scores WHERE", f"FROM {_ALL_OR_WIKI} WHERE") + """
SELECT model, scope, n, revert_rate, auc, accuracy, f1 FROM t""")
def metrics_grouping_sets(t: Tables):
    table = Sl.metrics_grouping_sets(t.scores())
    return _rounded(table, ["model", "scope", "n"], ["revert_rate", "auc", "accuracy", "f1"])


_PARTS = """(SELECT *, 'all' AS scope, 'full' AS part FROM scores UNION ALL SELECT *, wiki_db, 'full' FROM scores
UNION ALL SELECT *, 'all', 'balanced' FROM scores WHERE is_balanced = 1
UNION ALL SELECT *, wiki_db, 'balanced' FROM scores WHERE is_balanced = 1)"""


@query(_long("part, scope", where="model = 'incumbent'").replace("FROM scores WHERE", f"FROM {_PARTS} WHERE") + f""",
l AS (SELECT part, scope, round(avg(-({Y} * ln(p) + (1 - {Y}) * ln(1 - p))), 6) AS log_loss FROM (
  SELECT *, least(greatest(score, 1e-15), 1 - 1e-15) AS p FROM {_PARTS} WHERE model = 'incumbent' AND score IS NOT NULL) GROUP BY part, scope)
SELECT part, scope, n, log_loss, auc, precision, recall, f1, accuracy FROM t JOIN l USING (part, scope)""")
def eval_metric_set(t: Tables):
    rows = t.history.select(LABEL, WIKI, "is_balanced", F.col("incumbent_pred").alias("score"))
    return _rounded(Sl.eval_metric_set(rows), ["part", "scope", "n"], ["log_loss", "auc", "precision", "recall", "f1", "accuracy"])


_POPULATIONS = "(SELECT *, 'all' AS population FROM scores UNION ALL SELECT *, 'anonymous' FROM scores WHERE is_anonymous)"
_BALANCED = f"""sized AS (SELECT *, row_number() OVER (PARTITION BY population, wiki_db, revision_is_identity_reverted ORDER BY {_hash('revision_id')}) AS rn,
  count(*) FILTER (WHERE revision_is_identity_reverted) OVER (PARTITION BY population, wiki_db) AS n1,
  count(*) FILTER (WHERE NOT revision_is_identity_reverted) OVER (PARTITION BY population, wiki_db) AS n0
  FROM (SELECT *, 'all' AS population FROM history UNION ALL SELECT *, 'anonymous' FROM history WHERE is_anonymous)),
even AS (SELECT population, revision_id FROM sized WHERE rn <= CASE WHEN population = 'all' AND revision_is_identity_reverted THEN n1 ELSE least(n0, n1) END),
b AS (SELECT s.model, e.population, {Y.replace('revision_is', 's.revision_is')} AS y, CAST(coalesce(s.score, -1) > 0.5 AS INT) AS p FROM scores s JOIN even e USING (revision_id)
  WHERE s.incumbent_pred IS NOT NULL),
d AS (SELECT model, population, round(avg(CAST(y = p AS INT)), 6) AS accuracy,
  round(2 * sum(y * p) / CAST(sum(y) + sum(p) AS DOUBLE), 6) AS f1 FROM b GROUP BY ALL)"""


@query(_long("population", where="incumbent_pred IS NOT NULL").replace("FROM scores WHERE", f"FROM {_POPULATIONS} WHERE") + f""",
k AS (SELECT model, population, sc, sum(y) OVER w AS tp, count(*) OVER w AS n, sum(y) OVER (PARTITION BY model, population) AS all_pos FROM s
  WINDOW w AS (PARTITION BY model, population ORDER BY sc DESC)),
pr AS (SELECT model, population, round(arg_max(CAST(tp AS DOUBLE) / n, sc), 6) AS precision_at_recall FROM k WHERE tp > 0.75 * all_pos GROUP BY ALL),
{_BALANCED}
SELECT model, population, auc, precision_at_recall, d.accuracy, d.f1 FROM t JOIN pr USING (model, population) JOIN d USING (model, population)""")
def model_leaderboard(t: Tables):
    scored = lambda df: joins.unpivot_scores(R.filter_scored(df, ["incumbent_pred"]), [LABEL, ANON], MODELS)
    board = Sl.model_leaderboard(
        scored(t.history), scored(Sa.balance_per_language(t.history)), scored(Sa.balance_two_sided(t.history))
    )
    return _rounded(board, ["model", "population"], ["auc", "precision_at_recall", "accuracy", "f1"])


@query("SELECT revision_id, wiki_db, model, round(score, 6) AS score FROM scores")
def unpivot_scores(t: Tables):
    return t.scores(*S.KEYS).select(*S.KEYS, "model", R6("score"))


@query(f"""SELECT revision_id, wiki_db, {Y} AS label, is_anonymous, round(incumbent_pred, 6) AS incumbent_pred,
round(linear_pred, 6) AS linear_pred, round(boosted_pred, 6) AS boosted_pred FROM history WHERE incumbent_pred IS NOT NULL""")
def fairness_input(t: Tables):
    models = list(MODELS.values())
    table = Fa.fairness_input(t.history, t.scores(*S.KEYS), models, "incumbent")
    return table.select(*S.KEYS, F.col(LABEL).cast("int").alias("label"), ANON, *[R6(f"{m}_pred") for m in models])


# --- fairness -----------------------------------------------------------------------------------

_SIDES = _long("is_anonymous") + """, g AS (SELECT *, n_pos / CAST(n AS DOUBLE) AS rr, (tp + fp) / CAST(n AS DOUBLE) AS pr FROM t),
u AS (SELECT * FROM g WHERE is_anonymous), p AS (SELECT * FROM g WHERE NOT is_anonymous)"""


@query(f"""SELECT round(avg({Y}) FILTER (WHERE is_anonymous) / avg({Y}) FILTER (WHERE NOT is_anonymous), 6) AS disparate_impact_base FROM history""")
def disparate_impact_base(t: Tables):
    return Fa.disparate_impact_base(t.history).select(R6("disparate_impact_base"))


@query("""SELECT model, round(avg(CAST(coalesce(score, -1) > 0.5 AS INT)) FILTER (WHERE is_anonymous)
/ avg(CAST(coalesce(score, -1) > 0.5 AS INT)) FILTER (WHERE NOT is_anonymous), 6) AS disparate_impact FROM scores GROUP BY model""")
def disparate_impact(t: Tables):
    return _rounded(Fa.disparate_impact(t.scores()), ["model"], ["disparate_impact"])


@query(_SIDES + " SELECT u.model, round(u.auc_raw - p.auc_raw, 6) AS auc_difference FROM u JOIN p USING (model)")
def auc_difference(t: Tables):
    return _rounded(Fa.auc_difference(t.scores()), ["model"], ["auc_difference"])


@query(_SIDES + """ SELECT u.model, round(u.rr / p.rr, 6) AS disparate_impact_base, round(u.pr / p.pr, 6) AS disparate_impact,
round(u.auc_raw - p.auc_raw, 6) AS auc_difference FROM u JOIN p USING (model)""")
def fairness_table(t: Tables):
    return _rounded(
        Fa.fairness_table(t.scores()), ["model"], ["disparate_impact_base", "disparate_impact", "auc_difference"]
    )


@query(_SIDES + """ SELECT u.model, round(u.pr - p.pr, 6) AS statistical_parity_difference,
round(p.pr * ln(p.pr / u.pr) + (1 - p.pr) * ln((1 - p.pr) / (1 - u.pr)), 6) AS kl_divergence,
round(2 * u.tp / CAST(2 * u.tp + u.fp + u.fn AS DOUBLE) - 2 * p.tp / CAST(2 * p.tp + p.fp + p.fn AS DOUBLE), 6) AS f1_difference,
round((u.tp + u.tn) / CAST(u.n AS DOUBLE) - (p.tp + p.tn) / CAST(p.n AS DOUBLE), 6) AS accuracy_difference FROM u JOIN p USING (model)""")
def group_gap_metrics(t: Tables):
    gaps = ["statistical_parity_difference", "kl_divergence", "f1_difference", "accuracy_difference"]
    return _rounded(Fa.group_gap_metrics(t.scores()), ["model"], gaps)


@query(f"""SELECT count(*) AS n, round(avg(CAST((incumbent_pred > 0.5) = revision_is_identity_reverted AS INT)), 6) AS accuracy
FROM history WHERE incumbent_pred IS NOT NULL""")
def accuracy_by_reference(t: Tables):
    return _rounded(Fa.accuracy_by_reference(R.filter_scored(t.history, ["incumbent_pred"]), "incumbent_pred"), ["n"], ["accuracy"])


@query(f"""SELECT revision_id, round(CAST('0x' || substr({_hash('revision_id')}, 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE), 6) AS u FROM history""")
def hash_uniform_score(t: Tables):
    return t.history.select(ID, F.round(hash_uniform(ID), 6).alias("u"))
