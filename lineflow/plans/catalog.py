"""Every registered query and, where one exists, its SQL counterpart."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "corpus_queries", "graph_queries", "search_queries", "policy_queries", "split_queries",
    "metric_queries",
)


def queries() -> dict:
    out: dict = {}
    for name in MODULES:
        out |= import_module(f"lineflow.plans.{name}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for name in MODULES:
        out |= import_module(f"lineflow.plans.{name}").ORACLE
    return out
