"""Queries by name, each with the SQL that an independent engine answers alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.sources.adapters import with_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, tables: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Registers a query under ``name``, with its counts and ranks as bigint; ``tables`` are the derived tables that ``sql`` reads."""

    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            return out.withColumns({c: out[c].cast("bigint") for c, kind in out.dtypes if kind == "int"})

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_tables(list(tables), sql)
        return f

    return register
