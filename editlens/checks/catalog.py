"""All registered queries."""

from editlens.checks import collect, evaluate, texts, train  # noqa: F401
from editlens.checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
