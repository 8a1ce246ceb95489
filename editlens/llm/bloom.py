"""Bit arrays for Bloom filters, built by aggregation and tested inside ordinary column expressions."""

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A filter is a constant of the plan; beyond this many bits (32 MB) building it is refused.
MAX_BITS = 1 << 28


@dataclass(frozen=True)
class Bits:
    """A filter of `size` bits as 64-bit words; empty filters have no words and contain nothing."""

    words: tuple[int, ...]
    size: int
    hashes: int
    seed: int

    def positions(self, key: Column) -> list[Column]:
        return _positions(key, self.size, self.hashes, self.seed)

    def contains(self, key: Column) -> Column:
        """False only if the key was not put in."""
        if not self.words:
            return F.lit(False)
        words = F.from_json(F.lit(json.dumps(self.words)), "array<bigint>")
        tests = [F.getbit(F.get(words, F.floor(p / 64).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1 for p in self.positions(key)]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


def _positions(key: Column, size: int, hashes: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed * 64 + i)), F.lit(size)) for i in range(hashes)]


def build(keys: DataFrame, column: str, n: int, bits_per_key: float, hashes: int, seed: int) -> Bits:
    """The filter of a key column with `n` keys. Only its words reach the driver, never the keys."""
    size = max(64, -(-int(n * bits_per_key + 1) // 64) * 64)
    if size > MAX_BITS:
        raise ValueError(f"{n} keys need {size} bits; the most is {MAX_BITS}. Cut the list by host and build one filter for each part")
    at = keys.select(F.explode(F.array(*_positions(F.col(column), size, hashes, seed))).alias("p"))
    found = (
        at.select(F.floor(F.col("p") / 64).cast("int").alias("w"), F.pmod("p", F.lit(64)).cast("int").alias("b"))
        .groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v")).collect()
    )
    words = [0] * (size // 64)
    for r in found:
        words[r["w"]] = r["v"]
    return Bits(tuple(words), size, hashes, seed)
