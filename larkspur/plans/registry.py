"""All registered queries and checks."""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES = ("curation", "knowledge", "answers", "operations")


def _modules():
    return [importlib.import_module(f"larkspur.plans.{name}") for name in MODULES]


def all_queries() -> dict[str, Callable]:
    return {name: fn for module in _modules() for name, fn in module.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for module in _modules() for name, sql in module.ORACLES.items()}
