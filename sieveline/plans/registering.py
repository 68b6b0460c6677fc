"""The registry that query modules add to."""

from __future__ import annotations

from collections.abc import Callable

from sieveline import catalog


def query(name: str, oracle: str | None = None) -> Callable:
    """Register a (spark, sf_dir) function, with the SQL that says the same."""

    def add(f: Callable) -> Callable:
        catalog.QUERIES[name] = f
        if oracle is not None:
            catalog.ORACLES[name] = oracle
        return f

    return add
