"""Where queries and their SQL are kept by name."""

from __future__ import annotations

from collections.abc import Callable

from cladeframe.session import ship

from .fixtures import oracle

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, more: str = ""):
    """Registers f(spark, sf_dir); sql: its result over the fixtures, in DuckDB."""

    def put(f):
        assert name not in QUERIES, name

        def run(spark, sf_dir):
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = oracle(sql, more)
        return f

    return put
