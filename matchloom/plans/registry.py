"""Queries and their DuckDB twins, collected from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matchloom.plans import library, matching, relational, reports, scoring, whole  # noqa: F401  (reports adds to relational)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**relational.queries(), **matching.QUERIES, **scoring.QUERIES, **library.QUERIES, **whole.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**relational.oracle_sql(), **matching.ORACLES, **scoring.ORACLES, **library.ORACLES}
