"""Queries over the driver's tables, each with its SQL."""

from agora.plans import files, graph, groups, landscape, opinions, relational, scoring, stances, streams, texts  # noqa: F401  registers its queries
from agora.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
