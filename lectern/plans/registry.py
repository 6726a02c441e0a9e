"""Queries over the reference's own operators, by name, and their SQL twins."""

from __future__ import annotations

from lectern.plans import corpus, documents, formulas, imports, model, structure, typography

_modules = [typography, documents, corpus, formulas, model, structure, imports]

QUERIES = {name: query for m in _modules for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _modules for name, sql in m.ORACLE_SQL.items()}
