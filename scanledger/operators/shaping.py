"""Filters that narrow a query before it runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXPLORATION_ROWS = 1000


def partition_filter(df: DataFrame, column: str, predicate: str) -> DataFrame:
    """Rows whose ``column`` meets ``predicate``, such as ``">= '2024-01-15'"``.

    On a partition column only the matching folders are read.
    """
    return df.where(F.expr(f"`{column}` {predicate}"))


def incremental(df: DataFrame, column: str, predicate: str) -> DataFrame:
    """Input of an incremental build: the rows ``predicate`` calls new.

    Write the result with ``sinks.versions.replace_range`` so that the days of
    the range are replaced as a whole, those without rows included.
    """
    return partition_filter(df, column, predicate)


def newer_than(df: DataFrame, column: str, built: DataFrame) -> DataFrame:
    """Rows past the highest ``column`` of what is built already; all when nothing is.

    The highest value is read first, so the scan gets a plain comparison: it
    prunes the folders of a partition column and is pushed to the files of others.
    """
    highest = built.agg(F.max(column)).first()[0]
    return df.where(F.col(column).isNotNull() if highest is None else F.col(column) > F.lit(highest))


def exploration_limit(df: DataFrame, rows: int = EXPLORATION_ROWS) -> DataFrame:
    return df.limit(rows)
