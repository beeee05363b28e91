"""Registered queries with the SQL each one is checked against."""

from __future__ import annotations

from importlib import import_module

#: The modules of this package that register queries.
MODULES = ("packed", "tokens", "memory", "logs", "session", "codegraph", "quality", "texts", "streaming", "store")


def _all(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        for key, value in getattr(import_module(f"{__name__}.{name}"), what).items():
            if key in found:
                raise ValueError(f"{key} is registered twice")
            found[key] = value
    return found


def registered() -> dict:
    """Every query of the core by name."""
    return _all("QUERIES")


def sql() -> dict:
    """The SQL of each query that SQL can express."""
    return _all("SQL")
