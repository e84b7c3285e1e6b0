"""All core queries and their SQL twins."""

from __future__ import annotations

from oxbow.plans import extras, functions, general, relational, sources, tpch, windows, workload

MODULES = [tpch, relational, workload, windows, functions, sources, extras, general]


def queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= m.ORACLE
    return out
