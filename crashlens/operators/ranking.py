"""Sorting, top-k and ranks. Every order is total: ties are broken by further columns, NULLs last."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordering(descending: Sequence[str] = (), ascending: Sequence[str] = ()) -> list[Column]:
    """Sort keys: first the descending columns, then the ascending ones, all with NULLs last."""
    return [F.col(c).desc_nulls_last() for c in descending] + [F.col(c).asc_nulls_last() for c in ascending]


def sort_by(df: DataFrame, descending: Sequence[str] = (), ascending: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(*ordering(descending, ascending))


def topk(df: DataFrame, k: int, descending: Sequence[str] = (), ascending: Sequence[str] = ()) -> DataFrame:
    """First ``k`` rows in order; each task keeps only its own best ``k``."""
    return sort_by(df, descending, ascending).limit(k)


def rank_slice(
    df: DataFrame, first: int, last: int, descending: Sequence[str] = (), ascending: Sequence[str] = ()
) -> DataFrame:
    """Rows ranked ``first`` to ``last``. The rank is taken over the top ``last`` rows, never the whole table."""
    window = Window.orderBy(*ordering(descending, ascending))
    return (
        topk(df, last, descending, ascending)
        .withColumn("_rank", F.row_number().over(window))
        .filter(F.col("_rank").between(first, last))
        .drop("_rank")
    )


def number_rows(
    df: DataFrame,
    groups: Sequence[str],
    descending: Sequence[str] = (),
    ascending: Sequence[str] = (),
    name: str = "rn",
) -> DataFrame:
    """Row number within each group.

    A window sorts each group in one task, so feed it aggregated rows, where a group is as large as its number
    of distinct values, not its number of source rows.
    """
    window = Window.partitionBy(*groups).orderBy(*ordering(descending, ascending))
    return df.withColumn(name, F.row_number().over(window))


def top1_per_group(
    df: DataFrame, groups: Sequence[str], descending: Sequence[str] = (), ascending: Sequence[str] = ()
) -> DataFrame:
    """Best row of each group. Spark limits each group before the exchange, so a hot group stays small."""
    numbered = number_rows(df, groups, descending, ascending, "_rank")
    return numbered.filter(F.col("_rank") == 1).drop("_rank")


def top_values(
    df: DataFrame, column: str, k: int, eligible: Column | None = None, rows: str | None = None
) -> DataFrame:
    """The ``k`` most frequent values of a column among the eligible ones, as (column, count).

    ``eligible`` is tested on the distinct values, not on every row: values that fail it are ranked behind all
    others and dropped after the limit, which keeps the optimizer from moving the test down to the scan.
    ``rows`` names a column that says how many rows a row stands for.
    """
    weight = F.count(F.lit(1)) if rows is None else F.sum(rows)
    counted = df.groupBy(column).agg(weight.alias("count"))
    if eligible is None:
        return topk(counted, k, ["count"], [column])
    passes = F.coalesce(eligible, F.lit(False))
    return (
        topk(counted.withColumn("_eligible", passes), k, ["_eligible", "count"], [column])
        .filter("_eligible")
        .drop("_eligible")
    )


def first_row(df: DataFrame, descending: Sequence[str] = (), ascending: Sequence[str] = ()):
    """First row in order as a ``Row``, or None for an empty table."""
    return topk(df, 1, descending, ascending).first()


def collect_bounded(df: DataFrame, bound: int) -> list:
    """Rows as a Python list, for results known to be small; raises rather than cutting off a larger one."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"more than {bound} rows: keep this result as a DataFrame")
    return rows
