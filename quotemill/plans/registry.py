"""The list of registered queries and, where one exists, the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

# Prices are decimals, so means often end in an exact half at the seventh place; the shift moves them
# off that edge, and engines that sum in different orders still round alike.
ROUNDING_SHIFT = 3.3e-8

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def add(name: str, query: Query, check: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: tidy(query(spark, sf_dir))
    if check is not None:
        CHECKS[name] = check


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six places, and no negative zero, so that equal results compare equal."""
    return df.select(
        *[
            (F.round(F.col(f"`{f.name}`") + ROUNDING_SHIFT, 6) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def log_growth(equity: str, start: float = 15000.0) -> Column:
    """Growth on a log scale; compounding makes raw account values too large to compare."""
    value = F.col(equity)
    return F.when(value > 0, F.ln(value / start))
