"""The registered queries and their DuckDB oracles."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under the name, with its oracle if SQL can express it."""
    def register(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f
    return register


from . import queries_arrays, queries_lattice, queries_neighbors, queries_records, queries_scalars, queries_validate, queries_windows  # noqa: E402, F401
