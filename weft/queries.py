"""Registered queries over the given tables, and their SQL."""

from .plans import agreement, copying, graphs, naming, networks, origins, similarity  # noqa: F401  (each module registers its queries)
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
