"""Registered queries and their SQL twins, by name."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers ``fn(tables) -> DataFrame``; ``sql`` is the independent twin over the same Parquet tables
    (left out where SQL cannot state the operator)."""

    def register(fn):
        from codestrata.plans.tables import Tables

        def run(spark, sf_dir):
            return fn(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register
