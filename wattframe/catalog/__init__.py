"""Registered queries, each with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, columns: str, sql: str | None = None):
    """Register a query.  ``columns`` lists the output; ``~c`` rounds ``c`` to
    six decimals, ``~3c`` to three, on both sides."""
    spec = []
    for part in columns.replace("\n", " ").split(","):
        part = part.strip()
        digits = None
        if part.startswith("~"):
            part, digits = part[1:], 6
            if part[0].isdigit():
                part, digits = part[1:], int(part[0])
        spec.append((part, digits))

    def wrap(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.select(
                *[
                    (F.col(c) if d is None else F.round(F.col(c), d) + F.lit(0.0)).alias(c)
                    for c, d in spec
                ]
            )

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            cols = ", ".join(
                c if d is None else f"round({c}, {d}) + 0.0 AS {c}" for c, d in spec
            )
            ORACLES[name] = f"SELECT {cols} FROM ({sql}) AS result"
        return run

    return wrap


def load() -> None:
    """Import every module that registers queries."""
    from wattframe.catalog import (  # noqa: F401
        counters,
        events,
        features,
        fleet,
        grid,
        match,
        models,
        score,
        stats,
        traces,
    )
