"""The queries of this subpackage and, where SQL can express them, the SQL for the same rows."""

from __future__ import annotations

from . import ann, bpe, chat, lmscore, media, neardup, packing, secrets, substrings, toxicity

MODULES = [packing, neardup, ann, substrings, toxicity, bpe, secrets, chat, media, lmscore]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
