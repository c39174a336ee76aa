"""All queries of the engine, by name, with their SQL."""

from __future__ import annotations

from . import briefs, corpus, details, files, networks, relations, search, sessions, tools  # noqa: F401  they register their queries
from .base import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
