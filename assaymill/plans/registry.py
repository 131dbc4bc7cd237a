"""Named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    run: Run
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        if name in REGISTRY:
            raise ValueError(f"two queries are called {name}")
        REGISTRY[name] = Query(name, covers, run, sql)
        return run

    return add


def published(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles at the table boundary: float sums depend on their order."""
    return df.select(
        *[
            (F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def r(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + cast(0 as double) AS {name}"
