"""Grouped counts and sums."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_values(df: DataFrame, keys: Sequence[str], column: str, count: str) -> DataFrame:
    """Per group, the number of rows where ``column`` is not NULL."""
    return df.groupBy(*keys).agg(F.count(column).alias(count))


def count_rows(df: DataFrame, keys: Sequence[str] = (), count: str = "count") -> DataFrame:
    """Per group, the number of rows (NULL is a group); one row for the whole table without keys."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count))


def sum_columns(df: DataFrame, keys: Sequence[str], sums: Mapping[str, str]) -> DataFrame:
    """Per group, several sums given as result name -> column; all-NULL groups sum to NULL."""
    return df.groupBy(*keys).agg(*[F.sum(column).alias(name) for name, column in sums.items()])


def having(df: DataFrame, keys: Sequence[str], aggregate: Column, condition: Column) -> DataFrame:
    """Groups whose aggregate meets the condition; ``condition`` names the aggregate by its alias."""
    return df.groupBy(*keys).agg(aggregate).filter(condition)
