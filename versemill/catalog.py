"""Registry of queries and their DuckDB equivalents."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query function (spark, sf_dir) -> DataFrame under `name`."""

    def wrap(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return wrap
