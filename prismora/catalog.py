"""All queries of the engine and the SQL that DuckDB answers them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .suites import decide, masks, measure, pixel, records

SUITES = (measure.S, pixel.S, masks.S, decide.S, records.S)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for suite in SUITES for name, f in suite.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for suite in SUITES for name, sql in suite.sql.items()}
