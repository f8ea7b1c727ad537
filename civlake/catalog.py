"""Queries of the core by name."""

from __future__ import annotations

from .functions import normalize
from .operators import areas, drift, ingest, metadata, metrics, orphans, peers, planning, predicates, resolve, search, spatial, units, wide
from .plans import answer
from .sources import tables
from .streaming import windows

MODULES = [orphans, wide, units, drift, normalize, predicates, metrics, areas, metadata, search, peers, planning, ingest, spatial, resolve, answer, tables, windows]
FLAGSHIP = "d9_rate_by_group"
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
