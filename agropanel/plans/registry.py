"""Registry of named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Run = Callable[[SparkSession, str], DataFrame]
RUNS: dict[str, Run] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        RUNS[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


def nudge(digits: int) -> float:
    """Small offset added before rounding for comparison, so that exact ties do not depend on the engine."""
    return 0.0123 * 10.0**-digits


def tidy(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded for comparison; other columns as they are."""
    kinds = dict(df.dtypes)
    return df.select(
        *[
            F.round(F.col(c) + F.lit(nudge(digits)), digits).alias(c) if kinds[c] == "double" else F.col(c)
            for c in df.columns
        ]
    )
