"""De-duplication and key checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashlens.operators.joins import join_per_key
from crashlens.operators.positions import free_name


def distinct_on(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct rows over some columns. The column list is part of the meaning: it defines the key."""
    return df.select(*columns).distinct()


def duplicate_keys(df: DataFrame, keys: Sequence[str], count: str = "count") -> DataFrame:
    """Keys that occur more than once, with their row count, fewest first."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias(count))
        .filter(F.col(count) > 1)
        .orderBy(F.col(count), *[F.col(key).asc_nulls_last() for key in keys])
    )


def duplicate_rows(df: DataFrame, keys: Sequence[str], count: str = "count") -> DataFrame:
    """All rows whose key occurs more than once, with the size of their group (rows with a NULL key drop out).

    The groups are counted with map-side aggregation and looked up from the rows. A window over the key would
    need one task to hold each whole group; the join can split a large one.
    """
    repeated = df.groupBy(*keys).agg(F.count(keys[0]).alias(count)).filter(F.col(count) > 1)
    return join_per_key(df, repeated, keys)


def key_ladder(df: DataFrame, key_sets: Mapping[str, Sequence[str]]) -> DataFrame:
    """Row count and number of distinct combinations per named key set; NULL counts as a value.

    A key set that is part of another one is made distinct from that one's distinct rows, so nested sets take one
    scan of the table and shuffle its keys once; sets that are part of no other run as branches of their own.
    """
    rows, ladder = free_name("_rows", df), dict[str, DataFrame]()
    for name in sorted(key_sets, key=lambda n: -len(key_sets[n])):
        finer = [other for other in ladder if set(key_sets[name]) <= set(key_sets[other])]
        source = ladder[min(finer, key=lambda n: len(key_sets[n]))] if finer else df
        # The test of the count, always true, keeps the optimizer from reading the table anew for the coarser set.
        groups = source.groupBy(*key_sets[name]).agg(F.count(F.lit(1)).alias(rows))
        ladder[name] = groups.filter(F.col(rows) > 0).select(*key_sets[name])

    def counted(name: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count(F.lit(1)).alias("combinations")).select(F.lit(name).alias("key_set"), "combinations")

    rungs = [counted("rows", df.select(F.lit(1)))] + [counted(name, ladder[name]) for name in key_sets]
    return reduce(DataFrame.unionAll, rungs)


def key_set_counts(df: DataFrame, key_sets: Mapping[str, Sequence[str]]) -> DataFrame:
    """As ``key_ladder``, for key sets that are not part of one another: one scan and one exchange for all of them.

    Each row is expanded to its combination of every set and made distinct before the exchange, so what moves is the sum of the
    sets' combinations. The ladder moves only the largest set's, but scans the table anew for each set that is part of no other.
    """
    columns = [name for name in df.columns if any(name in keys for keys in key_sets.values())]
    if lost := {key for keys in key_sets.values() for key in keys} - set(columns):
        raise ValueError(f"no such columns: {sorted(lost)}")
    mask, rows = free_name("_mask", df), free_name("_rows", df)

    def mask_of(keys: Sequence[str]) -> int:
        """The grouping id: a bit for each column that is not in the set, the first column's the highest."""
        return sum(1 << (len(columns) - 1 - i) for i, name in enumerate(columns) if name not in keys)

    sets = {mask_of(keys): [name for name in columns if name in keys] for keys in key_sets.values()}
    groups = df.groupingSets([[F.col(f"`{name}`") for name in keys] for keys in sets.values()], *[F.col(f"`{name}`") for name in columns])
    combinations = groups.agg(F.grouping_id().alias(mask), F.count(F.lit(1)).alias(rows))
    one = next(iter(sets))
    counts = [("rows", F.coalesce(F.sum(F.when(F.col(mask) == one, F.col(rows))), F.lit(0)))]
    counts += [(name, F.count(F.when(F.col(mask) == mask_of(keys), 1))) for name, keys in key_sets.items()]
    rungs = F.array(*[F.struct(F.lit(name).alias("key_set"), count.alias("combinations")) for name, count in counts])
    return combinations.agg(rungs.alias("rungs")).select(F.inline("rungs"))
