"""Every query over the test tables, and its SQL."""

from __future__ import annotations

from stratamem.plans import building, graph, knowledge, texts

MODULES = (graph, building, texts, knowledge)


def queries() -> dict:
    return {q.__name__: q for m in MODULES for q in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.oracle_sql().items()}
