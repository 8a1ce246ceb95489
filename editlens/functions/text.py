"""Text functions: sentences, lines, similarity, category links, interop decoding."""

import ast
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from editlens.schema import CHANGE_PAIRS


def split_sentences(text: Column) -> Column:
    """Sentences of a text: cut at `.`, `!`, `?` unless it ends the text, trimmed; empty ones stay."""
    return F.transform(
        F.split(text, r"[.!?](?!$)"), lambda s: F.regexp_replace(s, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")
    )


def split_lines(text: Column) -> Column:
    """Lines of a text, at any line separator, without the empty one after a final separator."""
    lines = F.split(text, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]")
    trimmed = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(trimmed)


def readable_title(title: Column) -> Column:
    """Title with `_` as space, null as empty."""
    return F.replace(F.coalesce(title, F.lit("")), F.lit("_"), F.lit(" "))


def language_code(wiki: Column) -> Column:
    """First two letters of the wiki name. Not a key: several wikis can share it."""
    return F.substring(wiki, 1, 2)


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence: common start and end, then one bit per character of `a` between."""
    shorter = min(len(a), len(b))
    start = 0
    while start < shorter and a[start] == b[start]:
        start += 1
    end = 0
    while end < shorter - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return start + end + len(a) - row.bit_count()


def ratio(a: str, b: str) -> int:
    """Similarity 0–100: twice the common length over both lengths, rounded half to even."""
    if a == b:
        return 100
    if not a or not b:
        return 0
    return round(200 * common_length(a, b) / (len(a) + len(b)))


@F.arrow_udf(T.IntegerType())
def _ratios(a: pa.Array, b: pa.Array) -> pa.Array:
    """Texts become Python's one pair at a time."""
    pairs = ((x.as_py(), y.as_py()) for x, y in zip(a, b, strict=True))
    return pa.array([None if x is None or y is None else ratio(x, y) for x, y in pairs], pa.int32())


def similarity_ratio(a: Column, b: Column, above: int | None = None) -> Column:
    """Similarity 0–100 of two strings.

    With `above`, pairs that cannot exceed it by their lengths and edit distance give null, natively,
    and never reach Python.
    """
    if above is None:
        return _ratios(a, b)
    lengths = F.length(a) + F.length(b)
    shorter = F.least(F.length(a), F.length(b))
    by_length = F.lit(200.0) * shorter > F.lit(float(above)) * lengths
    by_distance = F.lit(100.0) * (lengths - F.levenshtein(a, b)) > F.lit(float(above)) * lengths
    possible = by_length & by_distance
    score = _ratios(F.when(possible, a), F.when(possible, b))
    return F.when(score > above, score)


def category_links(text: Column, aliases: Column) -> Column:
    """Names in `[[prefix:name]]` links whose lower-cased prefix is one of the aliases (an array column)."""
    links = F.transform(
        F.regexp_extract_all(text, F.lit(r"\[\[([^\[\]]*)\]\]"), F.lit(1)), lambda s: F.replace(s, F.lit(","), F.lit(""))
    )
    named = F.filter(
        links,
        lambda s: F.contains(s, F.lit(":")) & F.array_contains(aliases, F.lower(F.substring_index(s, ":", 1))),
    )
    return F.transform(named, lambda s: F.regexp_replace(s, r"^[^:]*:", ""))


# Bare words, escapes JSON lacks, tuples, and more than one list are read by Python. A match inside quotes costs time only.
_AWKWARD = r"\\[xuUN0-9a]|(^|[\[(,\s])(None|True|False|nan)($|[\]),\s])|^\s*\(|\]\s*\["
_JSON_OPTIONS = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}


def _literal(text):
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return None


@F.pandas_udf(T.ArrayType(T.StringType()))
def _string_lists(values: pd.Series) -> pd.Series:
    parsed = [_literal(v) if isinstance(v, str) else None for v in values]
    return pd.Series([[str(x) for x in p] if isinstance(p, (list, tuple)) else None for p in parsed])


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _pair_lists(values: pd.Series) -> pd.Series:
    parsed = [_literal(v) if isinstance(v, str) else None for v in values]
    return pd.Series([
        [[str(x[0]), str(x[1])] for x in p]
        if isinstance(p, (list, tuple)) and all(isinstance(x, (list, tuple)) and len(x) == 2 for x in p)
        else None
        for p in parsed
    ])


def decode_strings(text: Column) -> Column:
    """List of strings written as a Python literal → array. Bad text → null.

    Plain quoting is read natively as JSON with single quotes; only text with escapes JSON lacks goes to Python.
    """
    awkward = text.rlike(_AWKWARD)
    native = F.from_json(F.when(~awkward, text), "array<string>", _JSON_OPTIONS)
    return F.coalesce(native, _string_lists(F.when(awkward, text)))


# A quoted string with its escapes, what stands between strings and round brackets, or one of those signs alone.
_PIECES = r"""(?s)'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^'"()]++|[()'"]"""
# Escapes that mean something else in JSON or nothing there, commas before an end, strings side by side.
_NOT_JSON = r"""(?s)\\[^\\'"ntrbf]|,\s*[)\]]|['"]\s*['"]"""
_MOST_ESCAPES = 1000


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` computed once per row, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _pairs_as_json(literal: Column) -> Column:
    """A literal that is a list of flat pairs in plain quoting, with square brackets only; null if Python has to look at it."""
    escapes = lambda t: F.length(t) - F.length(F.replace(t, F.lit("\\"), F.lit("")))
    pieces = lambda t: F.regexp_extract_all(
        F.when((escapes(t) <= _MOST_ESCAPES) & ~t.rlike(_NOT_JSON), t), F.lit(_PIECES), F.lit(0)
    )
    signs = lambda p: F.filter(p, lambda x: (F.length(x) == 1) | ~F.left(x, F.lit(1)).isin("'", '"'))
    brackets = lambda outside: F.regexp_replace(outside, r"[^()\[\]]", "")
    flat = lambda shape: shape.isin("[]", "()") | F.regexp_replace(shape, r"\(\)|\[\]", "").isin("[]", "()")
    plain = lambda p: _once(
        F.array_join(signs(p), ""), lambda outside: _once(brackets(outside), flat) & ~outside.rlike(r"[^\s,()\[\]]")
    )
    square = lambda p: F.array_join(F.transform(p, lambda x: F.when(x == "(", "[").when(x == ")", "]").otherwise(x)), "")
    return _once(literal, lambda t: _once(pieces(t), lambda p: F.when(plain(p), square(p))))


def decode_pairs(text: Column) -> Column:
    """List of (before, after) tuples written as a Python literal → array of structs. Bad text → null.

    Round brackets outside of quotes become square ones, and the rest is read natively as JSON with single quotes; only
    text that JSON would read differently goes to Python.
    """
    json = _pairs_as_json(text)
    read = F.from_json(json, "array<array<string>>", _JSON_OPTIONS)
    native = _once(read, lambda pairs: F.when(F.forall(pairs, lambda p: F.size(p) == 2), pairs))
    pairs = F.coalesce(_pair_lists(F.when(json.isNull(), text)), native)  # either is null where the other reads
    return F.transform(pairs, lambda p: F.struct(p[0].alias("before"), p[1].alias("after"))).cast(CHANGE_PAIRS)


def decode_counts(text: Column) -> Column:
    """Dictionary of counts written as a Python literal → map. Bad text → null."""
    return F.from_json(text, "map<string,int>", {"allowSingleQuotes": "true"})


def _quoted(text: Column) -> Column:
    for plain, escaped in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit("'"), text, F.lit("'"))


def encode_strings(array: Column) -> Column:
    """Array of strings as the Python literal the exchange files hold."""
    return F.concat(F.lit("["), F.array_join(F.transform(array, _quoted), ", "), F.lit("]"))


def encode_pairs(array: Column) -> Column:
    """Array of (before, after) structs as the Python literal the exchange files hold."""
    pair = lambda p: F.concat(F.lit("("), _quoted(p["before"]), F.lit(", "), _quoted(p["after"]), F.lit(")"))
    return F.concat(F.lit("["), F.array_join(F.transform(array, pair), ", "), F.lit("]"))


def encode_counts(counts: Column) -> Column:
    """Map of counts as the Python literal the exchange files hold."""
    entry = lambda e: F.concat(_quoted(e["key"]), F.lit(": "), e["value"].cast("string"))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(counts), entry), ", "), F.lit("}"))
