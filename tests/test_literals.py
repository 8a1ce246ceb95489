"""Literals of the exchange files read natively or by Python: always what Python's own reader gives."""

import ast

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from editlens.functions import text as X

FIXED = [
    None, "", "[]", "()", "[('a', 'b')]", "[('a', 'b'), ('c', 'd')]", "[['a', 'b']]", "(('a', 'b'), ('c', 'd'))", "[('a', 'b'),]", "[('a', 'b',)]",
    "[('a',)]", "[('a', 'b', 'c')]", "['a', 'b']", "[(1, 2.50)]", "[(None, 'a')]", "[('it\\'s', \"say \\\"x\\\"\")]", "[(\"it's\", '(no) [brackets]')]",
    "[('a\\nb', 'c\\td')]", "[('\\x41', 'b')]", "[('a\\d', 'b')]", "[('\\v', 'b')]", "[('a' 'b', 'c')]", "[(r'a', 'b')]", "[('a', 'b')", "[('a', 'b'])", "[('a', 'b')] ]",
    "[('a', 'b')][0]", "[('a', ('b', 'c'))]", "[('', '')]", "[ ( 'ä' , '日本 🙂' ) ]", "nonsense", "[('unclosed, 'b')]", "[('a\nb', 'c')]", "[('\\\\', '\\\\n')]",
    "[('a', \"b')]", "{'a': 'b'}", "[()]", "[('a', 'b'), ()]", "[(',)', '],')]", "[('a','b')('c','d')]", "[('\\\\d', 'b')]",
]


def plain(text):
    try:
        p = ast.literal_eval(text)
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return None
    if not isinstance(p, (list, tuple)) or not all(isinstance(x, (list, tuple)) and len(x) == 2 for x in p):
        return None
    return [(str(a), str(b)) for a, b in p]


def decoded(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.decode_pairs(F.col("t")).alias("p")).collect()
    return [None if r.p is None else [tuple(x) for x in r.p] for r in sorted(rows, key=lambda r: r.i)]


@pytest.mark.filterwarnings("ignore::SyntaxWarning")
def test_pairs(spark):
    got = decoded(spark, FIXED)
    for text, pairs in zip(FIXED, got, strict=True):
        assert pairs == (None if text is None else plain(text)), text


def test_any_pairs_come_back(spark):
    texts = []

    @given(st.lists(st.tuples(st.text(alphabet="a'\"\\()[],\n\tn é🙂", max_size=8), st.text(max_size=8)), max_size=4))
    @settings(max_examples=300, deadline=None)
    def gather(pairs):
        texts.append(str([(a.encode("utf-8", "ignore").decode(), b.encode("utf-8", "ignore").decode()) for a, b in pairs]))

    gather()
    assert decoded(spark, texts) == [plain(t) for t in texts]


def test_plain_pairs_stay_native(spark):
    texts = ["[('a', 'b (c)'), (\"it's\", 'x')]", "[]", "[('\\n', '\\\\')]"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert frame.where(X._pairs_as_json(F.col("t")).isNull()).count() == 0


def test_long_literals(spark):
    text = str([(f"it's {i}\n", f'say "{i}"') for i in range(20_000)])
    assert decoded(spark, [text]) == [plain(text)]
