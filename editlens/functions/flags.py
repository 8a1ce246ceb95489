"""Flags from array columns. A null array counts as empty."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_filled(array: Column) -> Column:
    """True if the array has an element."""
    return F.coalesce(F.size(array), F.lit(0)) > 0


def contains(array: Column, value: str) -> Column:
    """True if the array holds the value."""
    return F.coalesce(F.array_contains(array, F.lit(value)), F.lit(False))


def overlaps(array: Column, values: Sequence[str]) -> Column:
    """True if the array holds any of the values."""
    return F.coalesce(F.arrays_overlap(array, F.array(*map(F.lit, values))), F.lit(False))


def is_true(flag: Column) -> Column:
    """Flag with null read as false."""
    return F.coalesce(flag.cast("boolean"), F.lit(False))
