"""Every query of the library by name, with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, folder) under a name, and its oracle."""

    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


from . import q_evaluation, q_models, q_preprocess, q_trees  # noqa: E402,F401
