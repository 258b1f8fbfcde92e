"""One registry of the library's own queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def query(name: str, oracle: str | None = None):
    """Register a function of (spark, sf_dir) under a name, with SQL for the same rows."""

    def wrap(fn):
        REGISTRY[name] = (fn, oracle)
        return fn

    return wrap


def _load() -> None:
    from weftline import plans  # noqa: F401  importing registers


def queries() -> dict[str, Callable]:
    _load()
    return {name: fn for name, (fn, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
