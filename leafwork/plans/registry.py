"""Queries of the layout engine and the SQL they are held against, by name of what they show."""

from __future__ import annotations

from collections.abc import Callable

from . import document_queries, layout_queries

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
for _m in (layout_queries, document_queries):
    QUERIES.update(_m.QUERIES)
    ORACLES.update(_m.ORACLES)
