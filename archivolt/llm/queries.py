"""Query catalogue of the optional subpackage."""

from __future__ import annotations

from archivolt.llm import entities, groups, leaks, neighbours, packing, pagetext, subjects

MODULES = [entities, groups, leaks, neighbours, packing, pagetext, subjects]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in MODULES for k, v in m.ORACLE.items()}
