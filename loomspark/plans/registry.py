"""All queries of the core, by name."""

from __future__ import annotations

from loomspark.plans import answers, figures, graph, repository, search, training

_MODULES = [training, repository, graph, search, answers, figures]
FLAGSHIP = "keyword_search"


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _MODULES for k, v in m.ORACLE.items()}
