"""The catalogue of runnable queries and their SQL counterparts.

Each query states its output columns once, as ``name:type`` words (``i`` int, ``l``
bigint, ``s`` string, ``b`` boolean, ``dN`` double rounded to N places); both sides
are projected to that list, so that names and types agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_TYPES = {"i": "INT", "l": "BIGINT", "s": "STRING", "b": "BOOLEAN"}


def _projection(spec: str, engine: str) -> list[str]:
    out = []
    for word in spec.split():
        name, kind = word.split(":")
        if kind[0] == "d":
            out.append(f"round(CAST({name} AS DOUBLE), {kind[1:]}) + 0.0{'D' if engine == 'spark' else 'e0'} AS {name}")
        else:
            sql_type = _TYPES[kind]
            if engine == "duckdb" and sql_type == "STRING":
                sql_type = "VARCHAR"
            out.append(f"CAST({name} AS {sql_type}) AS {name}")
    return out


def query(name: str, spec: str, oracle: str | None = None):
    """Register a query under ``name`` with its output columns and its SQL text."""

    def wrap(fn: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf: fn(spark, sf).selectExpr(*_projection(spec, "spark"))
        if oracle is not None:
            ORACLES[name] = f"SELECT {', '.join(_projection(spec, 'duckdb'))} FROM ({oracle}) AS result"
        return fn

    return wrap
