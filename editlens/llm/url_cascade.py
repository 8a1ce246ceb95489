"""URL rules held in a Bloom filter cascade: exact membership without joins.

Level 1 encodes the listed keys. Level 2 encodes the keys of the corpus that level 1 takes for listed by mistake, level 3
the listed keys that level 2 takes for mistakes, and so on until nothing is left to encode. Over the keys that the corpus
can ask for (the universe: every host ending combined with every path start that a rule could have), the first level
that a key fails decides exactly. Levels shrink geometrically; only their bits reach the driver.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from editlens.llm import bloom
from editlens.llm.common import let
from editlens.session import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Cascade:
    levels: tuple[bloom.Bits, ...]

    def contains(self, key: Column) -> Column:
        """Exact for every key of the universe it was built over."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(~self.levels[i].contains(key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def build_cascade(listed: DataFrame, universe: DataFrame, seed: int = 0) -> Cascade:
    """Cascade of the `key` column of `listed` over that of `universe`. Repeated and null keys are allowed.

    The first level has 10 bits a key, so about one key in a hundred of the universe goes on; the further ones keep
    half of the other side. The universe is only filtered, never shuffled as a whole.
    """
    to_add = materialize(listed.where(F.col("key").isNotNull()).select("key").distinct(), "cascade")
    n = to_add.count()
    if n == 0:
        return Cascade(())
    first = bloom.build(to_add, "key", n, 10, 7, seed)
    wrong = universe.select("key").where(first.contains(F.col("key"))).distinct()
    other = materialize(wrong.join(to_add, "key", "left_anti"), "cascade")
    levels = [first]
    while (n := other.count()) > 0:
        level = bloom.build(other, "key", n, 1.44, 1, seed + len(levels))
        levels.append(level)
        to_add, other = other, materialize(to_add.where(level.contains(F.col("key"))), "cascade")
    return Cascade(tuple(levels))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII letters lowered) and path of a url; both empty for null or a url without `://`."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring_index(url, "://", 1)
    rest = F.substr(url, F.length(rest) + 4)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


@dataclass(frozen=True)
class RuleBook:
    """Cascades of the blocked and the allowed rules, with the shapes of rules that exist."""

    block: Cascade
    allow: Cascade
    labels: tuple[int, ...]
    path_lengths: tuple[int, ...]

    def keys(self, host: Column, path: Column) -> Column:
        return candidate_keys(host, path, self.labels, self.path_lengths)

    def judge(self, host: Column, path: Column) -> Column:
        """The longest rule that fits as struct(n, rule, blocked), or null."""
        blocked = lambda k: self.block.contains(k)
        hits = F.filter(self.keys(host, path), lambda k: blocked(k) | self.allow.contains(k))
        longest = F.array_max(F.transform(hits, lambda k: F.struct(F.length(k).alias("n"), k.alias("rule"))))
        return F.when(longest.isNotNull(), F.struct(longest["rule"].alias("rule"), blocked(longest["rule"]).alias("blocked")))


def candidate_keys(host: Column, path: Column, labels: Sequence[int], path_lengths: Sequence[int]) -> Column:
    """Every host ending with one of these label counts, followed by every start of the path with one of these lengths."""
    def ends(parts: Column) -> Column:
        n = F.size(parts)
        return F.flatten(F.transform(
            F.array(*[F.lit(k) for k in labels]),
            lambda k: F.when(k <= n, F.array(F.array_join(F.slice(parts, n - k + 1, k), "."))).otherwise(F.array()),
        ))

    starts = F.filter(
        F.transform(F.array(*[F.lit(k) for k in path_lengths]), lambda k: F.when(k <= F.length(path), F.substring(path, F.lit(1), k))),
        lambda s: s.isNotNull(),
    )
    pairs = let(starts, lambda s: F.flatten(F.transform(
        let(F.split(host, r"\."), ends), lambda h: F.transform(s, lambda p: F.concat(h, p))
    )))
    return F.when(host != "", pairs).otherwise(F.array().cast("array<string>"))


def build_rules(rules: DataFrame, urls: DataFrame) -> RuleBook:
    """Rules (host, path, verdict 'allow' or 'block') over the complete keys of `urls` (host, path).

    Rules with a null part are ignored. If a rule is both allowed and blocked, it blocks.
    """
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL AND host <> ''")
    shapes = rules.agg(
        F.sort_array(F.collect_set(F.size(F.split("host", r"\.")))).alias("labels"),
        F.sort_array(F.collect_set(F.length("path"))).alias("lengths"),
    ).first()
    labels, lengths = tuple(shapes["labels"]), tuple(shapes["lengths"])
    if not labels:
        return RuleBook(Cascade(()), Cascade(()), (), ())
    universe = urls.select(F.explode(candidate_keys(F.col("host"), F.col("path"), labels, lengths)).alias("key"))
    keys = rules.select(F.concat("host", "path").alias("key"), "verdict")
    block = build_cascade(keys.where("verdict = 'block'"), universe, 0)
    allow = build_cascade(keys.where("verdict = 'allow'"), universe, 1000)
    return RuleBook(block, allow, labels, lengths)


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """A short fixed list of (host, path, verdict) as a table."""
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*rows)))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """`pages` rows with host, path, rule and verdict; a url that no rule fits gets `default`.

    The longest rule wins. A null or empty url, or one without a host, fits no rule. An empty table gives an empty result.
    """
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    book = build_rules(rules, parts)
    if not book.labels:
        return parts.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    hit = parts.withColumn("__hit", book.judge(F.col("host"), F.col("path")))
    verdict = F.when(F.col("__hit").isNull(), default).when(F.col("__hit.blocked"), "block").otherwise("allow")
    return hit.select("page_id", "host", "path", F.col("__hit.rule").alias("rule"), verdict.alias("verdict"))
