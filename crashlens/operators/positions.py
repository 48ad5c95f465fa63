"""Places of rows in the order of a whole table: row ids, row numbers of large groups, deep rank slices.

A window over a whole table, or over a group of any size, sorts it in one task. Here rows are exchanged by ranges of the order, each
range is written as a file, and a row's place is the rows of the files before plus its own place in the file. Orders as in ``ranking``: NULLs last; rows
that are equal in all named columns stand in any order among themselves, and in one range.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from crashlens.operators.ranking import ordering, rank_slice
from crashlens.sources.sinks import scratch_path, write_result

#: Probes that a round of counting compares each row with, and rows that are sorted once no more than these are left.
PROBES, FEW_ROWS = 31, 100_000


def free_name(name: str, *tables: DataFrame) -> str:
    """``name``, with underscores before it while a column is called so."""
    taken = {column.lower() for df in tables for column in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """The rows with their place in the order, from 0; stored, so the same whenever they are read."""
    spark = df.sparkSession
    stored = write_result(df.orderBy(*order), scratch_path(spark, "ordered"))
    file, place = free_name("_file", df), free_name("_place", df)
    files = stored.groupBy(F.col("_metadata.file_name").alias("file")).count()
    number = [F.regexp_extract("file", rf"{part}(\d+)", 1).cast("int") for part in ("part-", "-c")]
    # One row for each file: as many as the exchange has ranges, however many rows these hold.
    starts, before = [], 0
    for row in files.orderBy(*number).collect():
        starts.append((row["file"], before))
        before += row["count"]
    names, places = zip(*starts, strict=True) if starts else ((), ())
    table = pa.table({file: pa.array(names, pa.string()), place: pa.array(places, pa.int64())})
    rows = stored.select("*", F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(name))
    joined = rows.join(F.broadcast(spark.createDataFrame(table)), file)
    return joined.select(*(F.col(f"`{column}`") for column in df.columns), (F.col(place) + F.col(name)).alias(name))


def global_row_ids(df: DataFrame, descending: Sequence[str] = (), ascending: Sequence[str] = (), name: str = "row_id") -> DataFrame:
    """Each row with its place in the whole order, from 0, without gaps.

    Unlike ids made of a partition and a counter they are consecutive, and the same for any partitioning if the order is total. Sorts
    and stores the table when called.
    """
    return _numbered(df, ordering(descending, ascending), name)


def number_rows_in_ranges(
    df: DataFrame,
    groups: Sequence[str],
    descending: Sequence[str] = (),
    ascending: Sequence[str] = (),
    name: str = "rn",
) -> DataFrame:
    """As ``ranking.number_rows``, for groups of any size: a row's number is its place less that of the group's first row.

    A large group lies in several ranges, so no task sorts or holds it, and adaptive execution splits it where first places are joined. A NULL is a group
    of its own.
    """
    at = free_name("_at", df)
    rows = _numbered(df, [*ordering((), groups), *ordering(descending, ascending)], at)
    keys = [free_name(f"_group_{i}", df) for i in range(len(groups))]
    first, part = free_name("_first", df), free_name("_part", df)
    firsts = rows.groupBy(*(F.col(c).alias(key) for c, key in zip(groups, keys, strict=True))).agg(F.min(at).alias(first))
    # One more derived column gives the aggregated side an exchange of its own, see ``joins``.
    firsts = firsts.withColumn(part, F.hash(*keys).bitwiseAND(1))
    same = [F.col(c).eqNullSafe(F.col(key)) for c, key in zip(groups, keys, strict=True)]
    joined = rows.join(firsts, reduce(and_, same, F.hash(*groups).bitwiseAND(1) == F.col(part)))
    return joined.select(*(c for c in df.columns if c != name), (F.col(at) - F.col(first) + 1).alias(name))


def _after(df: DataFrame, columns: Sequence[tuple[str, bool]], values: Sequence) -> Column:
    """True for rows that stand after the values in the order; columns with whether they descend.

    NaN is tested for by itself: it is the largest number, but statistics of files and of cached tables leave it out.
    """
    after = F.lit(False)
    for (name, descending), value in reversed(list(zip(columns, values, strict=True))):
        column = F.col(name)
        nan = F.isnan(column) if isinstance(df.schema[name].dataType, (FloatType, DoubleType)) else F.lit(False)
        if value is None:
            beyond, same = F.lit(False), column.isNull()
        elif value != value:
            beyond, same = column.isNull() | (~nan if descending else F.lit(False)), column.isNotNull() & nan
        else:
            beyond = column.isNull() | (~nan & (column < F.lit(value)) if descending else nan | (column > F.lit(value)))
            same = column.eqNullSafe(F.lit(value))
        after = beyond | (same & after)
    return after


def narrowed(
    df: DataFrame, first: int, last: int, descending: Sequence[str] = (), ascending: Sequence[str] = (), few: int = FEW_ROWS
) -> tuple[DataFrame, int]:
    """The rows between two keys, among them all ranked ``first`` to ``last``, and the number of rows before these.

    Each round draws rows at random, counts exactly how many rows stand up to each of them, and goes on between the two next to the
    wanted ranks, until ``few`` rows are left or the rest are ties or wanted. A round scans the key columns and moves a count for
    each probe and task, no rows.
    """
    columns = [(c, True) for c in descending] + [(c, False) for c in ascending]
    names = [c for c, _ in columns]
    low = high = upto = None
    before = 0

    def between() -> DataFrame:
        rows = df if low is None else df.where(_after(df, columns, low))
        return rows if high is None else rows.where(~_after(df, columns, high))

    while upto is None or upto - before > few:
        keys = between().select(*names)
        drawn = keys.orderBy(F.rand(7)).limit(PROBES).distinct().orderBy(*ordering(descending, ascending)).collect()
        cell = sum((_after(df, columns, probe).cast("int") for probe in drawn), F.lit(0))
        counts = {row["cell"]: row["count"] for row in keys.groupBy(cell.alias("cell")).count().collect()}
        seen, was = before, (before, upto)
        for at, probe in enumerate(drawn):
            seen += counts.get(at, 0)
            if seen < first:
                low, before = tuple(probe), seen
            if seen >= last and (upto is None or seen < upto):
                high, upto = tuple(probe), seen
        if upto is None:
            upto = seen + counts.get(len(drawn), 0)
        if (before, upto) == was:
            break
    return between(), before


def deep_rank_slice(
    df: DataFrame, first: int, last: int, descending: Sequence[str] = (), ascending: Sequence[str] = (), few: int = FEW_ROWS
) -> DataFrame:
    """Rows ranked ``first`` to ``last``, as ``ranking.rank_slice``, however deep they stand.

    Counts keys when called, and sorts only what is left between two of them; the rest of the table is scanned but never moved. A slice
    of more than ``few`` rows gets its ranks by ranges.
    """
    rows, before = narrowed(df, first, last, descending, ascending, few)
    if last - before <= few:
        return rank_slice(rows, first - before, last - before, descending, ascending)
    at = free_name("_at", df)
    return global_row_ids(rows, descending, ascending, at).where(F.col(at).between(first - before - 1, last - before - 1)).drop(at)
