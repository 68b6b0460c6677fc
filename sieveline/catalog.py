"""Registry of the retrieval queries: name -> (Spark callable, DuckDB text). Query modules add to it when they are imported."""

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def load() -> None:
    from sieveline.plans import queries_evaluate, queries_mining, queries_search, queries_text  # noqa: F401
