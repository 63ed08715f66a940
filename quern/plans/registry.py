"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Blanks as Python strips them, as an RE2 class.
_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"


def stripped(x: str) -> str:
    """SQL for x without blanks around."""
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def collapsed(x: str) -> str:
    return f"regexp_replace({stripped(x)}, '{_WS}+', ' ', 'g')"


def query(sql: str | None = None):
    """Registers a function of (spark, table reader) under its name."""

    def add(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add
