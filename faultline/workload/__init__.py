"""Queries over the test tables, one or more per operator, with SQL that gives the same result."""

from __future__ import annotations

from importlib import import_module

from faultline.workload.registry import QUERIES, Query

_MODULES = ("parsing", "statistics", "diagnosis", "commands", "records")


def all_queries() -> dict[str, Query]:
    for module in _MODULES:
        import_module(f"faultline.workload.{module}")
    return QUERIES
