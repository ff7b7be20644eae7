"""All registered queries of the library's own operators."""

from __future__ import annotations

from lectorium.plans import catalogue, juries, panels, ratings, readers, research

_MODULES = (ratings, catalogue, research, readers, juries, panels)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
