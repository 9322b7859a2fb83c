"""Registered queries and the SQL each must agree with."""

from __future__ import annotations

from workloads import extraction, planning, retrieval, transcripts

_MODULES = (extraction, retrieval, planning, transcripts)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.query.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.query.sql.items()}
