"""Registered queries on the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from . import catalogue, columns, maps, merges, pages, records, relational, review, vectors

_ALL = [relational, columns, records, merges, catalogue, pages, vectors, maps, review]


def queries() -> dict:
    return {name: q for m in _ALL for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _ALL for name, sql in m.ORACLE_SQL.items()}
