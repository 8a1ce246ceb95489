"""Score functions: softmax of raw model outputs, prediction recoding."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax_pair(s0: Column, s1: Column) -> tuple[Column, Column]:
    """Probabilities of two raw scores, safe for large values."""
    top = F.greatest(s0, s1)
    e0, e1 = F.exp(s0 - top), F.exp(s1 - top)
    return e0 / (e0 + e1), e1 / (e0 + e1)


def recoded_prediction(scores: Column, model: str = "damaging") -> Column:
    """First prediction of a model in a score map as a flag; anything but 'true' / 'false' → null."""
    first = F.get(F.try_element_at(scores, F.lit(model)).getField("prediction"), F.lit(0))
    return F.when(first == "true", F.lit(True)).when(first == "false", F.lit(False))


def recoded_probability(scores: Column, model: str = "damaging") -> Column:
    """Probability of 'true' of a model in a score map, null if absent."""
    return F.try_element_at(F.try_element_at(scores, F.lit(model)).getField("probability"), F.lit("true"))
