"""All SQL statements, keyed like the registered queries."""

from __future__ import annotations

from checks import model_sql, report_sql, tables_sql, views_sql

MODULES = [views_sql, tables_sql, report_sql, model_sql]


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in MODULES:
        out.update(module.sql())
    return out
