"""Every query of the engine, with the SQL that gives the same rows."""

from __future__ import annotations

from quarrylens.plans import aggregates, graphs, joins, lists, mutations, parsing, retrieval, scalar, streams, windows  # noqa: F401  each registers its queries
from quarrylens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
