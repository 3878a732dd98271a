"""Query registry: name -> (Spark builder, DuckDB oracle SQL, rounded columns).

Registered outputs round their DOUBLE columns to 4 decimals on both sides
so the two engines' different summation orders cannot flip a value hash.
The Spark builders return lazy DataFrames; nothing is collected here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    doubles: tuple[str, ...] = field(default_factory=tuple)
    ops: str = ""


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, doubles=(), ops: str = ""):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, tuple(doubles), ops)
        return fn
    return deco


def _spark_side(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = q.build(spark, sf_dir)
        if not q.doubles:
            return df
        # "+ 0.0" turns a rounded -0.0 into 0.0 so both engines agree bit for bit
        return df.select(*[(F.round(F.col(c), 4) + F.lit(0.0)).alias(c) if c in q.doubles
                           else F.col(c)
                           for c in df.columns])
    run.__name__ = q.name
    run.__doc__ = q.build.__doc__
    return run


def _sql_side(q: Query) -> str:
    if not q.doubles:
        return q.sql
    rep = ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in q.doubles)
    return f"SELECT * REPLACE ({rep}) FROM (\n{q.sql}\n) AS oracle_q"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _spark_side(q) for n, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {n: _sql_side(q) for n, q in REGISTRY.items() if q.sql}
