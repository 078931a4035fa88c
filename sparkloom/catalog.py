"""All queries of the library and their DuckDB SQL."""

from __future__ import annotations

from .plans import catalogs, census, eventlog, governance, graphs, inventory, journeys, profile, program, scans, scores, stores, views, workflow  # noqa: F401  (they register their queries)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
