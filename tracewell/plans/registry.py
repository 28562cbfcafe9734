"""All queries of the library and their SQL twins."""

from __future__ import annotations

from . import containers, hits, traces

MODULES = [hits, traces, containers]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
