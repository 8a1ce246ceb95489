"""Hash order: a seeded, repeatable shuffle of keys that does not depend on partitions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from editlens.schema import SEED


def hash_order(*keys: str, seed: int = SEED) -> Column:
    """Hex digest of seed and keys; sorting by it is a random order of the keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))


def hash_uniform(*keys: str, seed: int = SEED) -> Column:
    """Uniform number in [0, 1) per key."""
    return F.conv(F.substring(hash_order(*keys, seed=seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
