"""Closed syncmers and the Bloom cascade against plain Python."""

import hashlib
import re
import struct

import xxhash
from pyspark.sql import functions as F

from editlens.llm import syncmers, url_cascade
from editlens.llm.queries import RULES


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def chain(seed, *values):
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(raw, seed & (1 << 64) - 1)
    return signed(seed)


def anchors_by_hand(text):
    w = [chain(42, p) for p in re.findall(r"[^\x20\x09-\x0D]{1,12}", text or "")]
    pairs = [chain(42, a, b) for a, b in zip(w, w[1:], strict=False)]
    if not w:
        return []
    if len(w) < 5:
        h = 0
        for x in w:
            h = chain(42, h, x)
        return [(h, 0)]
    out = []
    for i in range(len(w) - 4):
        inner = pairs[i:i + 4]
        if inner.index(min(inner)) in (0, 3) or inner[0] == min(inner) or inner[3] == min(inner):
            out.append((chain(42, pairs[i], pairs[i + 2], w[i + 4]), i))
    return out


def test_fingerprints(awkward):
    rows = sorted(((r.doc_id, r.text or "") for r in awkward.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want = []
    sketch = lambda t: sorted({h & 0xFFFFFFFF for h, _ in anchors_by_hand(t)})[:128]

    def like(a, b):
        least = sorted(set(a) | set(b))[:128]
        return 1.0 if not least else len([h for h in least if h in set(a) and h in set(b)]) / len(least)

    for (i, t), (_, other) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(t) // 2
        edited = t[:len(t) - half] + other[:half]
        a, b, c = sketch(t), sketch(edited), sketch(other)
        hexes = lambda s: "".join(f"{h:08x}" for h in s)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexes(a), hexes(b), round(like(a, b), 9), round(like(a, c), 9)))
    got = [(*r[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in syncmers.fingerprints(awkward).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_ranges_of_ids_change_nothing(awkward):
    ends = lambda n: sorted(map(str, syncmers.with_next(awkward, F.length("text"), n).collect()))
    assert ends(1) == ends(3) == ends(1000)


def test_anchors_match_by_place(spark):
    row = spark.createDataFrame([("a b c d e f g h i j k l m n", "z y x a b c d e f g h i j k l m n")], "a string, b string")
    found = row.select(syncmers.matches(syncmers.anchors(F.col("a")), syncmers.anchors(F.col("b"))).alias("m"), syncmers.anchors(F.col("a")).alias("own")).first()
    assert len(found.m) == len(found.own) > 0 and {m.other - m.place for m in found.m} == {3}


def test_nothing_to_fingerprint(empty):
    assert syncmers.fingerprints(empty).count() == 0


URLS = [
    None, "", "no scheme", "://", "http://", "http://EXAMPLE.org/es/1", "http://a.example.org/en/17?x=/de/", "http://org/", "http://org", "http://forg/x",
    "http://www.shop.com/fr/a#b", "http://shop.com/de/", "http://shop.com/de", "x://y://z.org/a", "http://shop.com?/fr/", "http://shop.com#/fr/", "http://b.net/fr/",
    "http://É.Org/ä", "http://..org/", "http://example.org/en/1", "http://notexample.org/es/", "http://" + "a." * 300 + "com/fr/" + "x" * 5000,
]


def judge_by_hand(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
    host = re.sub("[A-Z]+", lambda m: m[0].lower(), host)
    fits = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda f: len(f[0])) if fits else (None, "allow")
    return host, path, rule, verdict


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "html", "allow") for i, u in enumerate(URLS)] + [(0, URLS[6], None, None), (None, URLS[5], None, None)], "page_id long, url string, html string, verdict string")
    got = url_cascade.judge_urls(pages, url_cascade.rule_table(spark, RULES)).collect()
    want = [(r.page_id, *judge_by_hand(r.url)) for r in pages.collect()]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    none = pages.limit(0)
    assert url_cascade.judge_urls(none, url_cascade.rule_table(spark, RULES)).count() == 0
    assert url_cascade.judge_urls(pages, url_cascade.rule_table(spark, RULES).limit(0)).where("verdict = 'block'").count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("key"), "id").alias("key"))
    listed = universe.where("hash(key) % 7 = 0")
    cascade = url_cascade.build_cascade(listed.unionByName(listed), universe)
    assert len(cascade.levels) >= 3
    found = universe.where(cascade.contains(F.col("key")))
    assert found.exceptAll(listed).count() == 0 and listed.exceptAll(found).count() == 0
