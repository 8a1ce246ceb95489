"""Counts of edit actions per content type, from the markup elements of two texts.

Flat elements (words, lines, headings, ...) are the matches of a pattern; bracketed ones (templates, links, tables, ...) come
from one scan of the text. Per type, the start and the end the two element lists have in common are kept in place. In
between, the i-th copy of a value in the old text meets the i-th in the new one; copies are gained, lost or kept.
min(gained, lost) of a type count as changed, the rest as inserted or removed. Of the kept copies, those outside a longest
run that is in order in both texts have moved.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editlens import schema as S
from editlens.functions.text import language_code
from editlens.operators.diff import CURRENT_TEXT, PARENT_TEXT
from editlens.operators.markup import bracketed_elements, link_prefix, out_of_order

#: Patterns of the flat types. All of them take time in proportion to the text.
WIKITEXT_PATTERNS = {
    "ExternalLink": r"https?://[^\s\[\]<>|{}]+",
    "HTMLEntity": r"&#?[A-Za-z0-9]+;",
    "Heading": r"(?m)^=+[^=\n]+=+",
    "List": r"(?m)^[*#:;][^\n]*",
    "Paragraph": r"[^\n]++(?:\n[^\n]++)*+",  # possessive: the loop then needs no stack per line
    "Punctuation": r"[.,;:!?]",
    "Section": r"(?m)^==[^=\n]+==",
    "Sentence": r"[^.!?\n]+[.!?]*",
    "Table Element": r"(?m)^[|!](?!\})[^\n]*",
    "Text": r"[^\n]+",
    "Text Formatting": r"'{2,5}",
    "Whitespace": r"[ \t\n\r]+",
    "Word": r"\p{L}+",
}

#: Types the scan finds; a link is a Category, a Media or a Wikilink by its prefix.
BRACKETED = ["Argument", "Category", "Comment", "Gallery", "Media", "Reference", "Table", "Template", "Wikilink"]

#: Prefixes every language has; those of a language come from a table.
LINK_PREFIXES = {"category": "Category", "file": "Media", "image": "Media", "media": "Media"}

# Text every match of a pattern contains. Where it is absent, which is cheap to see, the pattern is not run.
REQUIRED_TEXT = {
    "ExternalLink": "://", "HTMLEntity": "&", "Heading": "=", "Section": "==", "Text Formatting": "''",
}


def _found(text: Column, kind: str, pattern: str, group: int) -> Column:
    """All matches of a pattern in a text."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    if kind not in REQUIRED_TEXT or WIKITEXT_PATTERNS.get(kind) != pattern:
        return values
    return F.when(F.contains(text, F.lit(REQUIRED_TEXT[kind])), values).otherwise(F.array().cast("array<string>"))


def _matches(text: Column, side: str, patterns: dict[str, str], group: int) -> Column:
    per_type = [
        F.transform(
            _found(text, kind, pattern, group),
            lambda v, i: F.struct(
                F.lit(kind).alias("type"), F.lit(side).alias("side"), i.alias("place"), v.alias("value")
            ),
        )
        for kind, pattern in patterns.items()
    ]
    return F.flatten(F.array(*per_type))


#: Link prefixes of all languages together; the table of them is sent to every task.
MOST_ALIASES = 10_000
#: Tasks that take texts apart, for each shuffle partition.
FINER = 4
#: Columns with the bracketed elements of the parent's and the current text.
OLD_FOUND, NEW_FOUND = "__old_found", "__new_found"


def scan_brackets(df: DataFrame, parent: str = PARENT_TEXT, current: str = CURRENT_TEXT) -> DataFrame:
    """Adds what the scan finds in both texts, for texts that are written once and compared later."""
    return df.withColumns({
        name: bracketed_elements(F.coalesce(F.col(text), F.lit(""))) for name, text in ((OLD_FOUND, parent), (NEW_FOUND, current))
    })


def with_link_types(df: DataFrame, aliases: DataFrame | None, name: str, wiki: str = S.WIKI) -> DataFrame:
    """Adds a map from lower-cased link prefixes to types: those of the row's language and those all languages have.

    `aliases` has rows (lang, alias, type), a few per language; upper and lower case are the same in any script. More than
    MOST_ALIASES rows are an error.
    """
    common = F.create_map(*[F.lit(x) for pair in LINK_PREFIXES.items() for x in pair])
    if aliases is None:
        return df.withColumn(name, common)
    if len(aliases.limit(MOST_ALIASES + 1).take(MOST_ALIASES + 1)) > MOST_ALIASES:
        raise ValueError("too many link aliases to send to every task")
    alias = F.lower(F.trim("alias")).alias("alias")
    unique = aliases.where(~alias.isin(list(LINK_PREFIXES))).groupBy(F.col("lang").alias("__lang"), alias).agg(F.min("type").alias("type"))
    maps = unique.groupBy("__lang").agg(F.map_from_entries(F.collect_list(F.struct("alias", "type"))).alias("__own"))
    joined = df.join(F.broadcast(maps), language_code(F.col(wiki)) == F.col("__lang"), "left")
    own = F.coalesce("__own", F.create_map().cast("map<string,string>"))
    return joined.withColumn(name, F.map_concat(common, own)).drop("__lang", "__own")


def _link_type(value: Column, types: Column) -> Column:
    return F.coalesce(F.element_at(types, link_prefix(value)), F.lit("Wikilink"))


def values_of(kind: str, elements: Column, types: Column) -> Column:
    """Values of one bracketed type, in order of place."""
    if kind in ("Category", "Media", "Wikilink"):
        wanted = F.filter(elements, lambda e: (e["type"] == "Link") & (_link_type(e["value"], types) == kind))
    else:
        wanted = F.filter(elements, lambda e: e["type"] == kind)
    return F.coalesce(F.transform(wanted, lambda e: e["value"]), F.array().cast("array<string>"))


def extract_elements(
    df: DataFrame, text: str, patterns: dict[str, str] | None = None, keys: Sequence[str] = S.KEYS, group: int = 0,
    aliases: DataFrame | None = None,
) -> DataFrame:
    """Rows (keys, type, place, value) of the elements of a text: all wikitext types, or those of the given patterns."""
    flat = F.transform(
        _matches(F.col(text), "own", WIKITEXT_PATTERNS if patterns is None else patterns, group),
        lambda e: F.struct(e["type"].alias("type"), e["place"].alias("place"), e["value"].alias("value")),
    )
    if patterns is not None:
        return df.select(*keys, F.inline(flat))
    scanned = with_link_types(df.select(*keys, text, bracketed_elements(F.col(text)).alias("__found")), aliases, "__types")
    per_type = [
        F.transform(
            values_of(kind, F.col("__found"), F.col("__types")),
            lambda v, i: F.struct(F.lit(kind).alias("type"), i.alias("place"), v.alias("value")),  # noqa: B023
        )
        for kind in BRACKETED
    ]
    return scanned.select(*keys, F.inline(F.concat(flat, *per_type)))


def extract_categories(
    df: DataFrame, text: str, aliases: DataFrame | None = None, keys: Sequence[str] = S.KEYS
) -> DataFrame:
    """Per row the names of its category links, in order, by the prefixes of its language."""
    scanned = with_link_types(df.select(*keys, text, bracketed_elements(F.col(text)).alias("__found")), aliases, "__types")
    links = values_of("Category", F.col("__found"), F.col("__types"))
    inner = F.transform(links, lambda v: F.replace(F.regexp_extract(v, r"(?s)^\[\[[^:]*:(.*)\]\]$", 1), F.lit(","), F.lit("")))
    return scanned.select(*keys, inner.alias("categories"))


def _first_difference(old: Column, new: Column) -> Column:
    """Place (from 1) where two arrays first differ, 0 if they do not."""
    same = F.zip_with(old, new, lambda a, b: a.eqNullSafe(b))
    return F.when(old == new, 0).otherwise(F.array_position(same, F.lit(False)).cast("int"))


def _rest(array: Column, first: Column) -> Column:
    """What is left of an array from its first difference on."""
    return F.when(first == 0, F.slice(array, 1, 0)).otherwise(F.slice(array, F.greatest(first, F.lit(1)), F.size(array)))


def _differing_middle(df: DataFrame, old: str, new: str) -> DataFrame:
    """Cuts the common start and the common end off two array columns, so that later work grows with the edit."""
    for _ in range(2):  # the second pass sees reversed arrays and turns them back
        first = _first_difference(F.col(old), F.col(new)).alias("__first")
        df = df.select("*", first).withColumns({c: F.reverse(_rest(F.col(c), F.col("__first"))) for c in (old, new)})
        df = df.drop("__first")
    return df


def _met_elements(
    df: DataFrame, patterns: dict[str, str] | None, keys: list[str], parent: str, current: str, group: int,
    aliases: DataFrame | None, dealt: bool,
) -> DataFrame:
    """Rows (keys, type, gained, lost, places): how many copies only one side has, and the new places of the others by old place.

    Texts and what the scan found in them are hashed to their revision once; the groupings below are finer than that and
    need no shuffle. The scan comes before it, for a Python step forgets how rows are dealt. The number of tasks is named, for
    elements take many times the bytes of the texts: tasks that are merged by those bytes would sort on disk.
    """
    found = [c for c in (OLD_FOUND, NEW_FOUND) if patterns is None and c in df.columns]
    changed = df.where(~F.col(parent).eqNullSafe(F.col(current))).select(*keys, parent, current, *found)
    texts = {"__old": F.coalesce(F.col(parent), F.lit("")), "__new": F.coalesce(F.col(current), F.lit(""))}
    kinds = [
        F.struct(F.lit(kind).alias("type"), *[_found(text, kind, pattern, group).alias(n) for n, text in texts.items()])
        for kind, pattern in (WIKITEXT_PATTERNS if patterns is None else patterns).items()
    ]
    if patterns is None:
        changed = with_link_types(changed if found else scan_brackets(changed, parent, current), aliases, "__types")
        kinds += [
            F.struct(F.lit(kind).alias("type"), *[values_of(kind, F.col(f"{n}_found"), F.col("__types")).alias(n) for n in texts])
            for kind in BRACKETED
        ]
    tasks = FINER * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per_type = (changed if dealt else changed.repartition(tasks, *keys)).select(*keys, F.inline(F.array(*kinds))).where((F.size("__old") > 0) | (F.size("__new") > 0))
    rest = _differing_middle(per_type, "__old", "__new")
    placed = lambda side, is_new: F.transform(
        side, lambda v, i: F.struct(v.alias("value"), i.alias("place"), F.lit(is_new).alias("is_new"))
    )
    # The null entry keeps types whose elements are all in common.
    entries = F.concat(placed(F.col("__old"), False), placed(F.col("__new"), True))
    elements = rest.select(*keys, "type", F.inline_outer(entries))
    places = elements.groupBy(*keys, "type", "value").agg(
        F.array_sort(F.collect_list(F.when(~F.col("is_new"), F.col("place")))).alias("__old"),
        F.array_sort(F.collect_list(F.when(F.col("is_new"), F.col("place")))).alias("__new"),
    )
    both = F.least(F.size("__old"), F.size("__new"))
    met = F.zip_with(
        F.slice("__old", F.lit(1), both), F.slice("__new", F.lit(1), both),
        lambda a, b: F.struct(a.alias("old"), b.alias("new")),
    )
    return places.groupBy(*keys, "type").agg(
        F.sum(F.size("__new") - both).alias("gained"),
        F.sum(F.size("__old") - both).alias("lost"),
        F.array_sort(F.flatten(F.collect_list(met)))["new"].alias("places"),
    )


def element_actions(
    df: DataFrame, patterns: dict[str, str] | None = None, keys: Sequence[str] = S.KEYS,
    parent: str = PARENT_TEXT, current: str = CURRENT_TEXT, group: int = 0, aliases: DataFrame | None = None,
    dealt: bool = False,
) -> DataFrame:
    """Rows (keys, type, change, insert, move, remove) for types with any element in a text that differs.

    All wikitext types, or those of the given patterns; `aliases` names further link prefixes per language. `dealt` says that
    the texts are dealt by the keys already and, for wikitext types, went through `scan_brackets`.
    """
    met = _met_elements(df, patterns, list(keys), parent, current, group, aliases, dealt)
    changes = F.least("gained", "lost")
    return met.select(
        *keys, "type", changes.alias("change"), (F.col("gained") - changes).alias("insert"),
        out_of_order(F.array("places"))[0].cast("long").alias("move"), (F.col("lost") - changes).alias("remove"),
    )


def edit_action_counts(
    df: DataFrame, patterns: dict[str, str] | None = None, keys: Sequence[str] = S.KEYS,
    parent: str = PARENT_TEXT, current: str = CURRENT_TEXT, group: int = 0, aliases: DataFrame | None = None,
    dealt: bool = False,
) -> DataFrame:
    """Per revision with a text difference a map `<action>_<type>` → count, zero counts left out."""
    met = _met_elements(df, patterns, list(keys), parent, current, group, aliases, dealt)
    types = met.groupBy(*keys).agg(F.collect_list(F.struct("type", "gained", "lost", "places")).alias("__t"))
    moved = types.withColumn("__moved", out_of_order(F.transform("__t", lambda t: t["places"])))
    changes = lambda t: F.least(t["gained"], t["lost"])
    counts = {
        "change": lambda t, _: changes(t), "insert": lambda t, _: t["gained"] - changes(t),
        "move": lambda _, n: n, "remove": lambda t, _: t["lost"] - changes(t),
    }
    entries = F.flatten(F.array(*[
        F.zip_with("__t", "__moved", lambda t, n: F.struct(  # noqa: B023
            F.concat(F.lit(f"{a}_"), t["type"]).alias("name"), counts[a](t, n).cast("int").alias("n")  # noqa: B023
        ))
        for a in S.ACTION_TYPES
    ]))
    return moved.select(*keys, F.map_from_entries(F.filter(entries, lambda e: e["n"] > 0)).alias("actions"))


def node_texts(
    df: DataFrame, patterns: dict[str, str] | None = None, keys: Sequence[str] = S.KEYS, parent: str = PARENT_TEXT,
    current: str = CURRENT_TEXT, group: int = 0, kinds: Sequence[str] = S.NODE_TYPES, aliases: DataFrame | None = None,
) -> DataFrame:
    """Rows (keys, node_type, action, text) of elements only one of the two texts has, one per extra copy.

    Wikitext elements of the given kinds, or those of the given patterns.
    """
    keys = list(keys)
    changed = df.where(~F.col(parent).eqNullSafe(F.col(current))).select(*keys, parent, current)
    sides = {"old": F.coalesce(F.col(parent), F.lit("")), "new": F.coalesce(F.col(current), F.lit(""))}
    flat = patterns if patterns is not None else {k: p for k, p in WIKITEXT_PATTERNS.items() if k in kinds}
    found = [_matches(text, side, flat, group) for side, text in sides.items()] if flat else []
    scanned = [k for k in BRACKETED if k in kinds] if patterns is None else []
    if scanned:
        changed = with_link_types(changed.withColumns({f"__{n}": bracketed_elements(text) for n, text in sides.items()}), aliases, "__types")
        found += [
            F.transform(
                values_of(kind, F.col(f"__{side}"), F.col("__types")),
                lambda v, i: F.struct(F.lit(kind).alias("type"), F.lit(side).alias("side"), i.alias("place"), v.alias("value")),  # noqa: B023
            )
            for kind in scanned for side in sides
        ]
    weight = F.when(F.col("side") == "new", 1).otherwise(-1)
    rows = changed.repartition(*keys).select(*keys, F.inline(F.concat(*found)))
    deltas = rows.groupBy(*keys, "type", "value").agg(F.sum(weight).alias("__d"))
    return deltas.where(F.col("__d") != 0).select(
        *keys, F.col("type").alias("node_type"),
        F.when(F.col("__d") > 0, "insert").otherwise("remove").alias("action"),
        F.explode(F.array_repeat("value", F.abs("__d").cast("int"))).alias("text"),
    )
