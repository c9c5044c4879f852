"""Queries over the test tables by name, and the SQL that gives the same rows."""

from __future__ import annotations

from textspark.queries import algebra, conversations, features, gathering, languages, locales, networks, pieces, selections, spans, times, tokens, values

MODULES = (spans, tokens, values, times, locales, features, languages, conversations, pieces, selections, algebra, networks, gathering)


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
