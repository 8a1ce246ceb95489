"""Small documents with every awkward case: nulls, blanks, long texts, ties, repeated rows, extra columns."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).parent))
from made_up import prose  # noqa: E402

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use for their own columns
    T.StructField("size", T.StringType()), T.StructField("score", T.StringType()), T.StructField("kept", T.StringType()),
    T.StructField("items", T.StringType()), T.StructField("n_words", T.StringType()), T.StructField("key", T.StringType()),
])


def awkward_rows() -> list[tuple]:
    long_text = prose(7, 30_000)
    edited = long_text.split(" ")
    edited[100] = edited[20_000] = "changed"
    base = prose(1, 120)
    near = base.split(" ")
    near[60] = "other"
    texts = [
        (0, base, "en", "a"), (1, base, "en", "a"), (2, " ".join(near), "en", "a"), (3, base.upper().replace("É", "é").replace("Ñ", "ñ").replace("Ü", "ü"), "de", "b"),
        (4, None, None, None), (5, "", "en", "b"), (6, " \t\n\x0b\f\r ", "en", None), (7, "one two three", "fr", "c"), (8, "one two three", "fr", "c"),
        (9, long_text, "en", "a"), (10, " ".join(edited), "en", "a"), (11, "x" * 20_000, "en", "d"), (12, "日本語のテキスト" * 40, "ja", "d"),
        (13, "🙂🙃 smile\u2003wide blank\u00a0no break", "en", "e"), (14, "line one two\n\nline one two\nother\n line one two", None, "e"),
        (15, " ".join(["spam egg ham toast bread milk tea jam"] * 30), "en", "a"), (16, prose(3, 400), "en", "a"), (16, prose(3, 400), "en", "a"),
        (17, prose(4, 25) + " ###$$$ |&<>", "en", "a"), (None, prose(5, 60), "en", "a"), (None, prose(6, 60), "en", "zz"), (-5, "a b c d e", "en", "a"),
        (2**40, prose(8, 200) + "\x00", "es", "ü"), (18, "don't stop  now\r\n12345 §§ ok", "en", "b"),
    ]
    return [(i, t, lang, source, None if t is None else len(t), "s", "x", "k", "i", "w", "y") for i, t, lang, source in texts]


@pytest.fixture(scope="session")
def awkward(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)
