"""Registry of named queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Plan:
    """A query and the SQL text it must agree with, if there is one."""

    run: Run
    sql: str | None


PLANS: dict[str, Plan] = {}


def plan(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query under ``name``."""

    def add(run: Run) -> Run:
        if name in PLANS:
            raise ValueError(f"{name} is registered twice")
        PLANS[name] = Plan(lambda spark, sf_dir: flat(run(spark, sf_dir)), sql)
        return run

    return add


# Types that both engines hand out alike.
_COMMON = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double", "date": "string"}


def flat(df: DataFrame) -> DataFrame:
    """Results in the common types: 64-bit numbers, and dates as text."""
    return df.select(*[F.col(name).cast(_COMMON.get(kind, kind)).alias(name) for name, kind in df.dtypes])


def shown(column: str) -> Column:
    """A value as text, null written out."""
    return F.coalesce(F.col(column).cast("string"), F.lit("null")).alias(column)


def shown_sql(column: str) -> str:
    return f"coalesce(CAST({column} AS VARCHAR), 'null') AS {column}"


def rounded(value: Column, digits: int = 6) -> Column:
    """Half-up rounding that both engines compute alike."""
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def rounded_sql(value: str, digits: int = 6) -> str:
    return f"(floor(({value}) * 1e{digits} + 0.5) / 1e{digits})"
