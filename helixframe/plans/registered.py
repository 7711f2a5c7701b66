"""The registered queries, and their SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (t, spark), where t reads a table by name."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add
