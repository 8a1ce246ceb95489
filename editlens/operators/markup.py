"""Bracketed wikitext elements, found in one pass over a text with a stack of what is open.

Each element is opened and closed once, so the time grows with the text, whatever is left unclosed. The value of an element is its
own text: elements inside it are elements of their own and leave a mark in its place, so values together are no longer
than the text and an edit inside a nested element counts for that element alone. A closer drops what was opened
inside its element and is still open; closers without opener are plain text. Comments hide what they contain.
"""

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What stands in a value where a nested element was.
MARK = "\ufffc"
_TOKEN = re.compile(
    r"<!--|\{\{\{|\{\{|\}\}|\[\[|\]\]|\{\||\|\}|<ref\b[^<>]*>|</ref\s*>|<gallery\b[^<>]*>|</gallery\s*>", re.IGNORECASE
)
_OPENERS = {"{{{": "Argument", "{{": "Template", "[[": "Link", "{|": "Table", "<re": "Reference", "<ga": "Gallery"}
_CLOSERS = {"}}": ("Argument", "Template"), "]]": ("Link",), "|}": ("Table",), "</r": ("Reference",), "</g": ("Gallery",)}
_ELEMENTS = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("value", T.StringType())]))
#: Characters of texts whose elements are held as Python's strings.
CHARS = 1_000_000
#: Texts without any of these have no bracketed element.
_SIGN = r"<!--|\{\{|\[\[|\{\||(?i:<ref|<gallery)"


class _Open:
    """An element that is not closed yet: its kind, where it starts, where its own text goes on, and that text so far."""

    def __init__(self, kind: str, start: int):
        self.kind, self.start, self.at, self.parts = kind, start, start, []


def bracketed(text: str) -> list[tuple[str, str]]:
    """Type and own text of every closed element, in order of their starts."""
    found: list[tuple[int, str, str]] = []
    stack: list[_Open] = []
    n_open = dict.fromkeys(_OPENERS.values(), 0)
    at = 0

    def add(kind: str, start: int, end: int, value: str) -> None:
        found.append((start, kind, value))
        if stack:
            stack[-1].parts += [text[stack[-1].at:start], MARK]
            stack[-1].at = end

    def close(kinds: tuple[str, ...], start: int, end: int) -> int:
        """Closes the innermost open element of these kinds; the place to go on from."""
        dropped = []
        while stack[-1].kind not in kinds:
            dropped.append(stack.pop())
        element = stack.pop()
        for inner in reversed(dropped):
            element.parts += [text[element.at:inner.start], *inner.parts]
            element.at = inner.at
        for e in (element, *dropped):
            n_open[e.kind] -= 1
        whole = element.kind == "Argument" and text[start:start + 3] == "}}}"
        end = start + 3 if whole else end
        value = "".join([*element.parts, text[element.at:end]])
        if element.kind == "Argument" and not whole:  # a brace and a template
            add("Template", element.start + 1, end, value[1:])
        else:
            add(element.kind, element.start, end, value)
        return end

    last_comment = text.rfind("-->")
    while token := _TOKEN.search(text, at):
        start, at = token.span()
        sign = token.group()[:3].lower() if token.group()[0] == "<" else token.group()
        if sign == "<!-":
            if at <= last_comment:
                at = text.index("-->", at) + 3
                add("Comment", start, at, text[start:at])
        elif sign == "<re" and text[at - 2] == "/":
            add("Reference", start, at, token.group())
        elif sign in _OPENERS:
            stack.append(_Open(_OPENERS[sign], start))
            n_open[_OPENERS[sign]] += 1
        elif any(n_open[k] for k in _CLOSERS[sign]):
            at = close(_CLOSERS[sign], start, at)
        elif sign == "|}":
            at = start + 1  # the brace may belong to the end of a template
    found.sort(key=lambda e: e[0])
    return [(kind, value) for _, kind, value in found]


def _element_lists(ends: list[int], kinds: list[str], values: list[str]) -> pa.Array:
    rows = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())], ["type", "value"])
    return pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), rows)


@F.arrow_udf(_ELEMENTS)
def _bracketed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Elements of the texts, handed on when there are many, so that a batch's are never held together."""
    for texts in batches:
        ends, kinds, values, chars = [], [], [], 0
        for scalar in texts:
            text = scalar.as_py()
            for kind, value in bracketed(text) if text is not None else ():
                kinds.append(kind)
                values.append(value)
            ends.append(len(kinds))
            chars += len(text or "")
            if chars > CHARS:
                yield _element_lists(ends, kinds, values)
                ends, kinds, values, chars = [], [], [], 0
        yield _element_lists(ends, kinds, values)


def bracketed_elements(text: Column) -> Column:
    """Bracketed elements of a text as an array of (type, value). Texts without brackets do not reach Python."""
    return _bracketed(F.when(text.rlike(_SIGN), text))


def link_prefix(link: Column) -> Column:
    """Lower-cased prefix of a `[[prefix:name]]` link, empty if it has none or starts with the colon."""
    return F.lower(F.regexp_extract(link, r"^\[\[\s*([^:|\[\]\x{FFFC}]*?)\s*:", 1))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _out_of_order(lists: pa.Array) -> pa.Array:
    counts = []
    for row in lists.to_pylist():
        counts.append(None if row is None else [])
        for places in row or ():
            tails: list[int] = []  # the least end of an increasing run of each length
            for place in places or ():
                at = bisect_left(tails, place)
                tails[at:at + 1] = [place]
            counts[-1].append(len(places or ()) - len(tails))
    return pa.array(counts, pa.list_(pa.int32()))


def out_of_order(lists: Column) -> Column:
    """For each of several lists of distinct places, how many must move so that the rest is in order: all but a longest
    increasing subsequence. Only lists that are not in order reach Python."""
    unsorted = F.transform(lists, lambda places: F.when(places != F.array_sort(places), places))
    any_unsorted = F.exists(unsorted, lambda places: places.isNotNull())
    none = F.transform(lists, lambda places: F.lit(0))
    return F.when(any_unsorted, _out_of_order(F.when(any_unsorted, unsorted))).otherwise(none)
