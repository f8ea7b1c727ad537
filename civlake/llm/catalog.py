"""Queries of the subpackage by name."""

from __future__ import annotations

from . import containers, garbled, leaks, near_copies, neighbours

MODULES = [near_copies, neighbours, containers, leaks, garbled]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
