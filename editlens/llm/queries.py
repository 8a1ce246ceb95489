"""One query per operator, over the whole tables, with the SQL oracle where SQL can express it."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editlens.llm import (
    bpe, chosen_path, collocations, compression, cross_entropy, curriculum, hilbert, packing, syncmers, token_files, toxicity,
    url_cascade, whitening,
)
from editlens.llm.common import word_count
from editlens.session import materialize, work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Public vocabularies; the files are read where they are installed.
VOCABULARY, FLAT_VOCABULARY = "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"


@query()
def op1_separator_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Writes the documents as flat token files, forgets where they are, and finds them again.

    Ids come back by place: a partition of the scan is a file, in the same order. A document without its counterpart
    raises an error.
    """
    docs, path = _table(spark, folder, "documents"), work_path(spark, "tokens")
    token_files.write_token_files(docs, path, public_tokenizers.path(FLAT_VOCABULARY), public_tokenizers.PATTERN)
    found = token_files.scan_token_files(spark, path).withColumn("file_no", token_files.part_number())
    places = docs.select(
        "doc_id", F.spark_partition_id().alias("file_no"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("doc_no"), F.lit(True).alias("there"),
    )
    both = found.join(places, ["file_no", "doc_no"], "full")
    lost = F.raise_error(F.lit("documents and token files do not match"))
    return both.select(
        "doc_id", "file_no", "doc_no", "start",
        F.when(F.col("there") & F.col("n_tokens").isNotNull(), F.col("n_tokens")).otherwise(lost.cast("long")).alias("n_tokens"),
    )


@query("""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, source_size * 2.0::DOUBLE AS most,
  CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY most / weight, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, CASE WHEN level >= most / weight THEN most
  ELSE weight * max(CASE WHEN level < most / weight THEN level END) OVER () END AS target FROM l),
p AS (SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS quota,
  coalesce(CAST(sum(size) OVER (PARTITION BY d.source ORDER BY md5('42:' || doc_id), size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(least(greatest(quota - start, 0), size)
  + least(greatest(quota - start - source_size, 0), size) AS BIGINT) AS taken FROM p
""")
def op2_curriculum_mix(spark: SparkSession, folder: str) -> DataFrame:
    sizes = _table(spark, folder, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = curriculum.mix(materialize(sizes, "sizes"))
    first = F.array_min(F.transform("items", lambda i: i["position"]))
    return mixed.withColumn("__first", first).orderBy("__first", "doc_id").select("doc_id", "size", "source_size", "target", "taken")


@query()
def op3_compression_bands(spark: SparkSession, folder: str) -> DataFrame:
    return compression.with_verdict(_table(spark, folder, "documents"), ["doc_id"])


@query()
def op4_cross_entropy_difference(spark: SparkSession, folder: str) -> DataFrame:
    """The target is every document labelled as good; the background is the whole corpus."""
    docs = _table(spark, folder, "documents")
    return cross_entropy.score_corpus(docs, _table(spark, folder, "labels").where("quality = 1"), ["doc_id"])


@query()
def op5_closed_syncmers(spark: SparkSession, folder: str) -> DataFrame:
    return syncmers.fingerprints(_table(spark, folder, "documents"))


@query()
def op6_lexicon_automata(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = toxicity.learn(docs, _table(spark, folder, "labels"))
    return toxicity.with_score(docs, ["doc_id"], model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", toxicity.predicted(F.col("score")).alias("predicted")
    )


@query()
def op8_bpe_matrices(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return bpe.digests(docs, ["doc_id"], public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)


@query("""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(rule_host, rule_path, says) AS (VALUES """ + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES) + """),
m AS (SELECT page_id, host, path, rule_host || rule_path AS rule, says FROM h JOIN r
  ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
b AS (SELECT *, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule) DESC) AS n FROM m)
SELECT h.page_id, h.host, h.path, b.rule, coalesce(b.says, 'allow') AS verdict
FROM h LEFT JOIN b ON b.n = 1 AND h.page_id IS NOT DISTINCT FROM b.page_id AND h.host = b.host AND h.path = b.path
""")
def op7_bloom_cascade(spark: SparkSession, folder: str) -> DataFrame:
    return url_cascade.judge_urls(_table(spark, folder, "pages"), url_cascade.rule_table(spark, RULES))


@query()
def op9_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    rows = hilbert.shard_documents(_table(spark, folder, "documents"))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit(hilbert.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        "cell",
    )


@query()
def op10_chosen_path(spark: SparkSession, folder: str) -> DataFrame:
    return chosen_path.near_duplicates(_table(spark, folder, "documents"), chosen_path.PERCENT)


#: A tokenizer with word ends, and the id that ends a document.
WORD_VOCABULARY, END_ID = "word_bpe_49k.json", 2


@query()
def op11_hierarchical_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(_table(spark, folder, "documents"), ["doc_id"], public_tokenizers.path(WORD_VOCABULARY), END_ID)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query()
def op12_weighted_whitening(spark: SparkSession, folder: str) -> DataFrame:
    white = whitening.whiten(_table(spark, folder, "embeddings"), ["vec_id"], "embedding")
    return white.withColumn("deviation", F.col("deviation").cast("long"))


@query("""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, doc_id, piece, nr FROM (SELECT lang, doc_id,
    unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece,
    generate_subscripts(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]'), 1) AS nr FROM documents)),
t AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
g AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM t),
o AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3 FROM g),
f1 AS (SELECT lang, w1, count(*) AS f FROM o GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM o WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM o WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
longer AS (SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
two AS (SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, x.f AS l, y.f AS r,
  f2.f::HUGEINT * f2.f * 1000000 // (x.f::HUGEINT * y.f) AS score
  FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
  LEFT JOIN longer ON longer.lang = f2.lang AND longer.w1 = f2.w1 AND longer.w2 = f2.w2
  WHERE longer.f IS NULL OR 100 * longer.f < 50 * f2.f),
cuts AS (SELECT f3.*, x.f AS xf, y.f AS yf, u.f AS uf, v.f AS vf,
  f3.f::HUGEINT * f3.f * 1000000 // (x.f::HUGEINT * v.f) AS s1, f3.f::HUGEINT * f3.f * 1000000 // (u.f::HUGEINT * y.f) AS s2
  FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f1 y ON y.lang = f3.lang AND y.w1 = f3.w3
  JOIN f2 u ON u.lang = f3.lang AND u.w1 = f3.w1 AND u.w2 = f3.w2 JOIN f2 v ON v.lang = f3.lang AND v.w1 = f3.w2 AND v.w2 = f3.w3),
every AS (SELECT * FROM two UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, f, CASE WHEN s1 <= s2 THEN xf ELSE uf END,
  CASE WHEN s1 <= s2 THEN vf ELSE yf END, least(s1, s2) FROM cuts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM every)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
""")
def op13_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(_table(spark, folder, "documents"))
