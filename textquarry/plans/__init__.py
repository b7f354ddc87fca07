"""Registered queries of the package's own operators: name to function, and name to DuckDB SQL."""

from __future__ import annotations

from . import files, pages, search, streams, texts

MODULES = (search, pages, texts, streams, files)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
