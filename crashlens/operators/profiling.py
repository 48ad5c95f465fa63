"""Table profiles: missing values, summary statistics, category values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType, StringType

from crashlens.functions import parse_number
from crashlens.operators.ranking import number_rows


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: per column, how many values are NULL or (floating-point columns) NaN. One pass over the table."""
    kinds = {field.name: field.dataType for field in df.schema.fields}

    def missing(name: str) -> Column:
        test = F.col(name).isNull()
        if isinstance(kinds[name], (DoubleType, FloatType)):
            test = test | F.isnan(name)
        return F.count(F.when(test, 1)).alias(name)

    return df.agg(*[missing(name) for name in columns or df.columns])


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: count of non-NULL values, mean, sample deviation, smallest and largest value.

    Number columns share one aggregation and all others another one, as the extremes of text would keep the numbers from compiled
    code; each reads its own columns. Text columns are averaged over the values that parse as numbers and ordered as text;
    dates, times and other types have no mean and deviation. Smallest and largest are given as text for every column, NULL for
    types without an order.
    """
    kinds = {field.name: field.dataType for field in df.schema.fields}

    def summary(name: str) -> Column:
        column = F.col(name)
        if isinstance(kinds[name], NumericType):
            number = column.cast("double")
        else:
            number = parse_number(name) if isinstance(kinds[name], StringType) else F.lit(None).cast("double")
        ordered = F.lit(None) if kinds[name].typeName() in ("map", "variant") else column
        return F.struct(
            F.lit(name).alias("column"),
            F.count(column).alias("count"),
            F.avg(number).alias("mean"),
            F.stddev(number).alias("stddev"),
            F.min(ordered).cast("string").alias("min"),
            F.max(ordered).cast("string").alias("max"),
        )

    names = list(columns or df.columns)
    numbers = [name for name in names if isinstance(kinds[name], NumericType)]
    others = [name for name in names if name not in numbers]
    parts = [df.agg(F.array(*map(summary, part)).alias("s")).select(F.inline("s")) for part in (numbers, others) if part]
    place = F.array_position(F.array(*map(F.lit, names)), F.col("column"))
    return reduce(DataFrame.unionAll, parts).coalesce(1).sortWithinPartitions(place)  # one row a column, in their order


def describe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """As ``describe`` for numeric columns, with the extremes as numbers."""
    return describe(df, columns).withColumns(
        {"min": F.col("min").cast("double"), "max": F.col("max").cast("double")}
    )


def category_values(df: DataFrame, column: str, where: Column | None = None) -> DataFrame:
    """Distinct values of one column, optionally among the rows that meet a condition."""
    rows = df if where is None else df.filter(where)
    return rows.select(column).distinct()


def frequent_values(df: DataFrame, k: int, columns: Sequence[str] | None = None) -> DataFrame:
    """Of every column, the ``k`` most frequent values with their rows, and the column's numbers of distinct values and of missing rows.

    One scan: each row becomes its (column, value) pairs, which are counted before the exchange, and Spark limits each column to
    ``k`` before its values meet. The pairs of a column with as many values as rows all move, as they must to be counted. Values are
    given as text; NULL is a value here, but not a distinct one; ties go to the smaller text, NULL last. A table without rows has
    no values.

    Result: column, place (from 1), value, count, n_distinct, n_missing.
    """
    names = list(columns or df.columns)
    pairs = F.array(*[F.struct(F.lit(name).alias("column"), F.col(f"`{name}`").cast("string").alias("value")) for name in names])
    counts = df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy("column").agg(
        F.count("value").alias("n_distinct"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("count"))), F.lit(0)).alias("n_missing"),
    )
    top = number_rows(counts, ["column"], ["count"], ["value"], "place").filter(F.col("place") <= k)
    return top.join(F.broadcast(totals), "column").select("column", "place", "value", "count", "n_distinct", "n_missing")  # a row a column
