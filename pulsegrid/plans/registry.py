"""All queries on the given tables, with their SQL."""

from __future__ import annotations

from . import catalog_queries, machine_queries, signal_queries

ALL = {**signal_queries.QUERIES, **machine_queries.QUERIES, **catalog_queries.QUERIES}
QUERIES = {name: run for name, (run, _) in ALL.items()}
SQL = {name: sql for name, (_, sql) in ALL.items() if sql}
